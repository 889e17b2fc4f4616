"""Token ids of whole texts by the tokenizers library, memoised by word inside each worker process."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from filetrail.llm.common import worker_store

# White space as Unicode defines it; regular texts have only single blanks and line ends, between words.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
RUNS = ["  ", "\n\n", " \n", "\n ", "\0"]
MEMO_WORDS = 2_000_000
KEY_BYTES = 16  # of a word with the blank or line end before it; longer ones are not kept
ODD_MEMO, ODD_CHARS = 100_000, 20  # words of texts with other white space
STEP_BYTES = 1 << 21


def regular(text: str) -> bool:
    """Every white space is one blank or one line end between two words; no byte is 0, which fills the memo's keys."""
    if any(run in text for run in RUNS) or any(c in text for c in OTHER_SPACE):
        return False
    return not (text[0] in " \n" or text[-1] in " \n")


class Memo:
    """Ids of up to `entries` words in flat arrays, found by their bytes through a table of row numbers with linear probing."""

    def __init__(self, entries: int, dtype: np.dtype):
        self.bits = max(4, (2 * entries - 1).bit_length())
        self.entries, self.dtype = entries, dtype
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((self.entries, 2), np.uint64)  # memory is taken as rows are filled
        self.ends = np.zeros(self.entries + 1, np.int32)
        self.ids = np.empty(0, self.dtype)
        self.rows = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        found = np.full(len(keys), -1, np.int32)
        slots, open_ = self._slots(hashes), np.arange(len(keys))
        while len(open_):
            row = self.table[slots]
            same = (row >= 0) & (self.keys[row, 0] == keys[open_, 0]) & (self.keys[row, 1] == keys[open_, 1])
            found[open_[same]] = row[same]
            on = (row >= 0) & ~same
            open_, slots = open_[on], (slots[on] + 1) & (len(self.table) - 1)
        return found

    def add(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows for keys that are distinct and not there yet; their ids follow each other in `ids`."""
        rows = np.arange(self.rows, self.rows + len(keys), dtype=np.int32)
        self.keys[rows] = keys
        self.ends[rows + 1] = len(self.ids) + np.cumsum(counts)
        self.ids = np.concatenate([self.ids, ids])
        self.rows += len(keys)
        slots, open_ = self._slots(hashes), np.arange(len(keys))
        while len(open_):
            free = self.table[slots] < 0
            self.table[slots[free]] = rows[open_[free]]
            on = self.table[slots] != rows[open_]
            open_, slots = open_[on], (slots[on] + 1) & (len(self.table) - 1)
        return rows


class Encoder:
    """Ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    A byte-level pre-tokenizer never joins a word with the white space after it, so a text may be cut before every run
    of white space, and the ids of the pieces follow each other. Words of regular texts are cut, looked up and put together in
    arrays, a few MB of text at a time. Words that the bounded memo does not hold go through the library in one text; each begins with
    the only id there that holds a blank or line end. Strings of special tokens inside texts
    are ordinary text. `Encoder` is for byte-level tokenizers without a normalizer and refuses others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = type(self.tokenizer.pre_tokenizer).__name__
        if self.tokenizer.normalizer is not None or kind != "ByteLevel":
            raise ValueError("only byte-level tokenizers without a normalizer can be cut at white space")
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a blank or a line end
        self.leads[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        self.line_end = len(self._whole("\n")) // self.dtype.itemsize  # ids of a line end, alone and before a word
        self.memo = Memo(MEMO_WORDS, self.dtype)
        self.odd_memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker process's encoder for that vocabulary file."""
        store = worker_store("encoders")
        if path not in store:
            store[path] = cls(path)
        return store[path]

    def _packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with the blank or line end before it, one after another, and how many each has."""
        text = b"".join(pieces).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(pieces):  # a vocabulary that cuts blanks or line ends otherwise
            each = [self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
            return np.array([i for own in each for i in own], self.dtype), np.array([len(own) for own in each], np.int64)
        return ids.astype(self.dtype), np.diff(np.append(starts, len(ids)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (`dtype`) of each text."""
        out: list[bytes] = [b""] * len(texts)
        step, size = [], 0
        for i, text in enumerate(texts):
            if text and regular(text):
                coded = text.encode()
                if size and size + len(coded) > STEP_BYTES:
                    self._step(step, out)
                    step, size = [], 0
                step.append((i, coded))
                size += len(coded)
            elif text:
                out[i] = b"".join(map(self._odd_piece, PIECE.findall(text)))
        if step:
            self._step(step, out)
        return out

    def _step(self, step: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Put the ids of regular texts, given with their numbers, into `out`."""
        data = b"\n" + b"\n".join([coded for _, coded in step])
        raw = np.frombuffer(data + bytes(KEY_BYTES), np.uint8)
        at = np.flatnonzero((raw == 32) | (raw == 10))  # every word begins with the one before it
        lengths = np.diff(np.append(at, len(data)))
        keys = np.lib.stride_tricks.sliding_window_view(raw, KEY_BYTES)[at].view("<u8")
        kept = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # bytes of a number that belong to the word
        keys[:, 0] &= kept[np.minimum(lengths, 8)]
        keys[:, 1] &= kept[np.clip(lengths - 8, 0, 8)]
        with np.errstate(over="ignore"):
            hashes = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (keys[:, 1] + np.uint64(0x85EBCA6B)) * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
        short = lengths <= KEY_BYTES
        row = np.full(len(at), -1, np.int32)
        row[short] = self.memo.find(keys[short], hashes[short])
        new = np.flatnonzero((row < 0) & short)
        _, which = np.unique(hashes[new], return_inverse=True)
        first = np.zeros(which.max() + 1 if len(new) else 0, np.int64)
        first[which] = new
        known = (keys[new] == keys[first[which]]).all(1)  # others have another word's hash
        if self.memo.rows + len(first) > self.memo.entries and self.memo.rows:
            self.memo.clear()
            return self._step(step, out)
        learnt, counts = self._learn([data[a:a + n] for a, n in zip(at[first].tolist(), lengths[first].tolist(), strict=True)])
        fits = len(first) <= self.memo.entries
        if fits:
            row[new[known]] = self.memo.add(keys[first], hashes[first], learnt, counts)[which[known]]
        rest = np.flatnonzero(row < 0)  # long words, and those that the memo has no room for
        words = [data[a:a + n] for a, n in zip(at[rest].tolist(), lengths[rest].tolist(), strict=True)]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        more, of_more = self._learn(list(number))
        ends = np.append(self.memo.ends[1:self.memo.rows + 1], len(self.memo.ids) + np.cumsum(of_more))
        row[rest] = self.memo.rows + np.array([number[w] for w in words], np.int32)
        pool = np.concatenate([self.memo.ids, more])
        begins = np.append(0, ends[:-1])[row].astype(np.int32)
        size = ends[row].astype(np.int32) - begins
        after = np.cumsum(size, dtype=np.int32)
        ids = pool[np.repeat(begins - (after - size), size) + np.arange(after[-1], dtype=np.int32)].tobytes()
        starts = np.cumsum([0] + [len(coded) + 1 for _, coded in step])
        words_before = np.searchsorted(at, starts)
        edges = np.append(0, after)[words_before].tolist()
        width = self.dtype.itemsize
        for (i, _), a, b in zip(step, edges[:-1], edges[1:], strict=True):
            out[i] = ids[(a + self.line_end) * width:b * width]

    def _odd_piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[0] == " " and piece[1] not in PLAIN_AFTER:
            coded = self.odd_memo.get(piece)
            if coded is None:
                coded = self._whole(piece)
                if len(self.odd_memo) >= ODD_MEMO:
                    self.odd_memo.clear()
                if len(piece) <= ODD_CHARS:
                    self.odd_memo[piece] = coded
            return coded
        return self._whole(piece)


# Characters that make a piece of an odd text no plain word after a blank.
PLAIN_AFTER = {" ", "\n", *OTHER_SPACE}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
