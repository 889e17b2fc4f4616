"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from filetrail.llm.common import bytes_of

STEP_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit moves about half of the output bits."""
    x = x + ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run of bytes without white space, A-Z lower-cased) and the text it belongs to."""
    inside = ~BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    letters = mix((place.astype(np.uint64) << np.uint64(8)) | LOWER[raw[starts[0]:]])
    letters[~inside[starts[0]:]] = 0
    return mix(np.add.reduceat(letters, starts - starts[0])), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, and where each text's begin.

    A text of fewer than n words has its whole sequence as its one shingle, a text without words has none.
    """
    texts = len(offsets) - 1
    hashes, owner = words(raw, offsets)
    counts = np.bincount(owner, minlength=texts)
    firsts = np.cumsum(counts) - counts
    rolled = hashes.copy()
    last = np.maximum(len(hashes) - 1, 0)
    at = np.arange(len(hashes))
    for j in range(1, n):
        follows = hashes[np.minimum(at + j, last)] if len(hashes) else hashes
        rolled = mix(rolled * ODD + follows)
    whole = at + n <= (firsts + counts)[owner] if len(hashes) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    one = hashes[firsts[short]] if len(short) else np.zeros(0, np.uint64)
    for j in range(1, n):
        more = counts[short] > j
        one = np.where(more, mix(one * ODD + hashes[np.minimum(firsts[short] + j, last)]) if len(short) else one, one)
    values = np.concatenate([rolled[whole], mix(one ^ counts[short].astype(np.uint64))])
    owners = np.concatenate([owner[whole], short])
    if len(short):
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=texts))]).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owners[new], minlength=texts))])


def steps(batch: pa.RecordBatch, column: str, most_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of a few MB of text: first row, row after the last, bytes, offsets."""
    raw, offsets = bytes_of(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, batch.num_rows)
        yield start, end, raw[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; an empty set has zeros."""
    padded = np.append(values, np.uint64(0))
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    if len(full):
        for k, mixed in enumerate((mix(padded), mix(padded ^ ODD))):
            mixed[-1] = 0
            out[k, full] = mix(np.add.reduceat(mixed, bounds[full]))
    return out[0], out[1]
