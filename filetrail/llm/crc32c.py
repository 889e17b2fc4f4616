"""CRC-32C of many byte strings at once, and the mask that record files put on it."""

from __future__ import annotations

import numpy as np

# The reflected Castagnoli polynomial and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
CHUNK = 1024
STEP_BYTES = 1 << 20  # of strings worked through at a time


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _slices() -> np.ndarray:
    """Row k: the effect of a byte that k more bytes follow."""
    rows = [_byte_table()]
    for _ in range(7):
        rows.append(rows[0][rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    return np.stack(rows)


SLICES = _slices()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24])


def _doublings() -> list[np.ndarray]:
    """Entry k: four tables that carry a state over 2**k zero bytes."""
    states = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    one = SLICES[0][states & 0xFF] ^ (states >> 8)
    out = [one]
    for _ in range(39):
        out.append(_apply(out[-1], out[-1]))
    return out


DOUBLINGS = _doublings()
OVER_CHUNK = DOUBLINGS[CHUNK.bit_length() - 1]


def crc32c(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of `raw[start:start+length]` for each pair.

    Strings are padded in front to whole chunks (zeros in front leave an empty state alone), chunks are worked through side
    by side, and their states are joined per string; the customary start state is added at the end.
    """
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    step = np.cumsum(lengths) // STEP_BYTES
    if step[0] != step[-1]:  # index arrays are several times the strings' bytes
        edges = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(starts)]
        return np.concatenate([_crc32c(raw, starts[a:b], lengths[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return _crc32c(raw, starts, lengths)


def _crc32c(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    chunks = np.maximum(1, -(-lengths // CHUNK))
    first = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(len(starts)), chunks)
    padded = np.zeros(int(first[-1]) * CHUNK, np.uint8)
    into = first[1:] * CHUNK - lengths
    at = np.repeat(into - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    padded[at] = raw[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
    words = padded.view("<u4").reshape(-1, CHUNK // 4)
    state = np.zeros(len(words), np.uint32)
    for k in range(0, CHUNK // 4, 2):
        a, b = words[:, k] ^ state, words[:, k + 1]
        state = (SLICES[7][a & 0xFF] ^ SLICES[6][(a >> 8) & 0xFF] ^ SLICES[5][(a >> 16) & 0xFF] ^ SLICES[4][a >> 24]
                 ^ SLICES[3][b & 0xFF] ^ SLICES[2][(b >> 8) & 0xFF] ^ SLICES[1][(b >> 16) & 0xFF] ^ SLICES[0][b >> 24])
    joined = state[first[:-1]]
    turn = np.arange(len(owner)) - first[owner]
    order = np.argsort(turn, kind="stable")
    edges = np.searchsorted(turn[order], np.arange(1, int(chunks.max()) + 1))
    for k in range(1, int(chunks.max())):
        rows = order[edges[k - 1]:edges[k]]
        joined[owner[rows]] = _apply(OVER_CHUNK, joined[owner[rows]]) ^ state[rows]
    begin = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max()).bit_length()):
        moved = _apply(DOUBLINGS[k], begin)
        begin = np.where((lengths >> k) & 1, moved, begin).astype(np.uint32)
    return ~(joined ^ begin)


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)).astype(np.uint32)
