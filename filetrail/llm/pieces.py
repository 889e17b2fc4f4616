"""SentencePiece models on the tokenizers library: read the model file, rebuild its parts, encode, decode, verify."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import crc_u32, texts_of, worker_store
from filetrail.llm.tokens import vocabulary_path

MARK = "▁"
PIECE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_ENTRIES = 600_000
MEMO_CHARS = 20
STEP_CHARS = 1 << 19
# Fixed values of the model format: field numbers, model kinds and piece kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(data, at)
            value = data[at:at + size]
            at += size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]  # text, score, kind
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            data = file.read()
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == PIECES:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""),
                   bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))

    def tokenizer(self):
        """The same model in the tokenizers library, for text that is normalized already."""
        from tokenizers import Tokenizer, decoders, models

        ids = {text: i for i, (text, _, _) in enumerate(self.pieces)}
        unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind == UNIGRAM:
            model = models.Unigram([(t, s) for t, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            # Better scores merge first; a piece has a merge for each way to halve it into pieces.
            usable = {t for t, _, k in self.pieces if k in (NORMAL, USER)}
            merges = [
                (-score, ids[text], ids[text[:i]], ids[text[i:]], (text[:i], text[i:]))
                for text, score, kind in self.pieces if kind in (NORMAL, USER)
                for i in range(1, len(text)) if text[:i] in usable and text[i:] in usable]
            model = models.BPE(ids, [m[-1] for m in sorted(merges)], unk_token=self.pieces[unknown][0], fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        out = Tokenizer(model)
        out.decoder = decoders.Sequence([
            decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
            *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def normalizer(self):
        """Its steps before the metaspace marker, or None if there are none."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None


class PieceEncoder:
    """Encodes and decodes whole texts as the model's own library does.

    No piece of the vocabulary holds a marker or a line end after other characters (checked when the model is read), so text is cut before
    each run of markers and before each line end, each distinct cut is encoded once, in multithreaded batches, and kept in a bounded memo. With
    `verify` every new cut is also encoded by the sentencepiece library and a difference is remembered.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.read(path)
        self.tokenizer, self.normalizer, self.threads = self.model.tokenizer(), self.model.normalizer(), threads
        plain = [t for t, _, kind in self.model.pieces if kind in (NORMAL, USER)]
        self.by_mark = not any(re.search(f"[^{MARK}]{MARK}", t) for t in plain)
        self.by_line = not any("\n" in t for t in plain)
        self.dtype = np.dtype("<u2" if len(self.model.pieces) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.parts = [self._shown(t, kind) for t, _, kind in self.model.pieces]
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    @classmethod
    def of(cls, path: str, threads: int = 2, verify: bool = True) -> PieceEncoder:
        store = worker_store("piece encoders")
        if (path, verify) not in store:
            store[path, verify] = cls(path, threads, verify)
        return store[path, verify]

    @staticmethod
    def _shown(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        if kind in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else text.replace(MARK, " ").encode()

    def normalized(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """Keys stand for themselves after a marker, or after nothing where they begin with a line end."""
        names = list(keys)
        whole = [k if k[:1] == "\n" and self.by_line else MARK + k for k in names]
        coded = {k: array(self.code, e.ids).tobytes() for k, e in zip(
            names, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True)}
        if self.library is not None and self.model.dummy_prefix and not self.model.remove_extra:
            asked = [(k, w) for k, w in zip(names, whole, strict=True) if k]
            said = self.library.encode([k.replace(MARK, " ") for k, _ in asked], num_threads=self.threads)
            for (k, w), ids in zip(asked, said, strict=True):
                if w[0] != MARK:
                    ids = ids[1:]  # the marker that the library puts first
                if array(self.code, ids).tobytes() != coded[k]:
                    self.differ.add(k)
        if len(self.memo) + len(coded) > MEMO_ENTRIES:
            self.memo.clear()
        self.memo.update((k, c) for k, c in coded.items() if len(k) <= MEMO_CHARS)
        return coded

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of each text, and whether the other library agrees on all its cuts."""
        out, agree, start = [], [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= STEP_CHARS):
                chars += len(texts[end])
                end += 1
            for ids, same in self._step(texts[start:end]):
                out.append(ids)
                agree.append(same)
            start = end
        return out, agree

    def _keys(self, text: str) -> list[str] | None:
        """Keys of a text whose markers and line ends stand alone, between other characters."""
        if not (self.by_mark and text[:1] == MARK):
            return None
        marked = text.replace("\n", f"{MARK}\n") if self.by_line else text
        keys = marked[1:].split(MARK)
        return None if "" in keys else keys

    def _step(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        cut: list[list[str]] = []
        whole: dict[int, bytes] = {}
        for i, text in enumerate(map(self.normalized, texts)):
            keys = self._keys(text) if text else []
            if keys is None:
                pieces = PIECE.findall(text) if self.by_mark else [text]
                if all(p[0] == MARK for p in pieces):
                    keys = [p[1:] if p[1:2] != "\n" else None for p in pieces]
                if keys is None or None in keys:
                    coded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
                    whole[i], keys = b"".join(array(self.code, e.ids).tobytes() for e in coded), []
            cut.append(keys)
        every = [k for keys in cut for k in keys]
        coded = list(map(self.memo.get, every))
        missing = {k for k, c in zip(every, coded, strict=True) if c is None}
        if missing:
            learnt = self._learn(missing)
            coded = [learnt[k] if c is None else c for k, c in zip(every, coded, strict=True)]
        out, at = [], 0
        for i, keys in enumerate(cut):
            ids = whole.get(i, b"".join(coded[at:at + len(keys)]))
            same = i not in whole and not (self.differ and self.differ.intersection(keys))
            if i in whole:
                same = self.library is None or array(self.code, self.library.encode(texts[i])).tobytes() == ids
            out.append((ids, same))
            at += len(keys)
        return out

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 are shown as the library shows them."""
        numbers = np.frombuffer(ids, self.dtype).tolist()
        data = b"".join(map(self.parts.__getitem__, numbers))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)


def encode_documents(docs: DataFrame, path: str | None = None, threads: int = 2, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip, parity, and `ids` if asked.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, decoded_crc32 over the UTF-8 bytes of the decoded text, which
    `round_trip` says is the text itself. `parity` says that the sentencepiece library gives the same ids. Null texts are empty and have
    no ids; a marker character inside a text comes back as a blank, so it does not make the round trip; repeated rows and null doc_ids
    are rows of their own; other columns are ignored; an empty table gives no row.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path, threads)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids, agree = encoder.encode(texts)
            shown = [encoder.decode(i) for i in ids]
            wide = [np.frombuffer(i, encoder.dtype).astype("<u4") for i in ids]
            out = [
                batch.column("doc_id"), pa.array([len(w) for w in wide], pa.int64()), pa.array([crc_u32(w) for w in wide], pa.int64()),
                pa.array([zlib.crc32(s.encode()) for s in shown], pa.int64()),
                pa.array([s == t for s, t in zip(shown, texts, strict=True)], pa.bool_()), pa.array(agree, pa.bool_())]
            if keep_ids:
                out.append(pa.array([w.tobytes() for w in wide], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
