"""Record files and packing against plain encoding, text by text."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from filetrail.llm import crc32c, packing, records
from filetrail.llm.tokens import Encoder, vocabulary_path
from pyspark.sql import functions as F

TEXTS = [None, "", "word", " two  words\n\nand\tmore ", "a b\nc d", "ünï çödé 日本 🙂", "x" * 70_000, "one two " * 9_000, "a b\nc d",
         "<|endoftext|> plain"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", 1) for i, t in enumerate(TEXTS)] + [(3, "word", "de", 2), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, ids int").repartition(5)


def plain(text, end):
    tokenizer = Encoder.of(vocabulary_path()).tokenizer
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_checksum_of_known_strings():
    raw = np.frombuffer(b"123456789" + bytes(32), np.uint8)
    assert crc32c.crc32c(raw, [0, 9, 0], [9, 32, 0]).tolist() == [0xE3069283, 0x8A9136AA, 0]
    rnd = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    table = crc32c.SLICES[0]
    for n in (1, 1023, 1024, 1025, 4999):
        state = 0xFFFFFFFF
        for b in rnd[:n].tolist():
            state = int(table[(state ^ b) & 255]) ^ (state >> 8)
        assert crc32c.crc32c(rnd, [0], [n])[0] == state ^ 0xFFFFFFFF


def test_encoder_equals_the_library():
    encoder, rnd = Encoder(vocabulary_path()), random.Random(3)
    letters = [*"ab'sé 1 2  \n\n\t\r\xa0　!?.<|>日\x1c\x85​ª²µ", "<|endoftext|>", "'ll", "über", " und.\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == plain(text, 0)[:-1], repr(text)


def test_encoder_with_words_that_a_memo_confuses_or_has_no_room_for():
    encoder = Encoder(vocabulary_path())
    encoder.memo = type(encoder.memo)(40, encoder.dtype)
    words = [f"w{i}" for i in range(30)]
    texts = ["a\0 b", "a b", "a\nb", " ".join(words), "\n".join(words), " ".join(f"{w}x" for w in words * 2), "c" * 15 + " " + "c" * 16,
             "fünfzehnzeichen日 fünfzehnzeichen日本", " ".join(f"v{i}" for i in range(100)), "b a"]
    for asked in (texts, *([t] for t in texts), texts[::-1]):
        got = [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(asked)]
        assert got == [plain(t, 0)[:-1] for t in asked]
    encoder.encode(["b a"])
    assert 0 < encoder.memo.rows <= 40


def test_checksums_hold_little_more_than_a_step_of_strings():
    n = 8_000
    raw, lengths = np.tile(np.frombuffer(bytes(range(250)) * 8, np.uint8), n // 2), np.full(n, 1000)
    tracemalloc.start()
    found = crc32c.crc32c(raw, np.arange(n) * 1000, lengths)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found.tolist())) == 1 and found[0] == crc32c.crc32c(raw, [0], [1000])[0]
    assert most < 80 << 20, most


def test_records_round_trip(spark, docs):
    index = records.with_starts(records.write_records(docs, end_id=0))
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.read_records(index).collect()),
                 key=lambda r: r[2])
    assert [r[1] for r in got] == sorted((r[1] for r in got), key=lambda d: (d is not None, d))
    start = 0
    for _, _, at, n, _ in got:
        assert at == start
        start += n
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(d), len(plain(t, 0)), crc(plain(t, 0))) for d, t in rows) == sorted((str(r[1]), r[3], r[4]) for r in got)
    shuffled = index.filter("doc_id % 2 = 0").repartition(7)
    kept = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(shuffled, keep_ids=True).collect()}
    assert kept == {i * 3: plain(t, 0) for i, t in enumerate(TEXTS) if i % 2 == 0}


def test_damaged_record_is_noticed():
    block = bytearray(records.framed([b"abcd", b""]))
    assert records.unframed(bytes(block), np.array([0, 20])) == [b"abcd", b""]
    for at in (0, 9, 13, 17):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            records.unframed(bytes(bad), np.array([0]))


def test_packing_holds_each_id_once(spark, docs):
    length = 64
    pieces = packing.pack(docs, length=length, end_id=1, keep_ids=True)
    rows = pieces.collect()
    flat = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        for i, t in enumerate(ids):
            assert flat.setdefault((r.sequence_id, r.offset + i), t) == t
    total = sum(len(plain(r.text, 1)) for r in docs.collect())
    assert sorted(flat) == [(i // length, i % length) for i in range(total)] and sum(r.length for r in rows) == total
    by_doc = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.sequence_id, r.offset)):
        by_doc.setdefault(str(r.doc_id), []).append(r)
    for i, t in enumerate(TEXTS):
        if i != 1:  # doc 3 is there twice
            own = sorted(by_doc[str(i * 3)], key=lambda r: r.start)
            assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == plain(t, 1)
            assert all(r.doc_tokens == len(plain(t, 1)) for r in own)
    whole = packing.sequences(pieces, length).orderBy("sequence_id").collect()
    assert [len(r.ids) // 4 for r in whole[:-1]] == [length] * (len(whole) - 1)
    assert np.frombuffer(whole[0].ids, "<u4").tolist() == [flat[0, i] for i in range(length)]
    last = whole[-1]
    assert len(last.ids) // 4 == (last.n_ids if last.n_ids & (last.n_ids - 1) == 0 else length)


def test_empty_table(spark, docs):
    none = docs.filter(F.lit(False))
    assert packing.pack(none).count() == 0
    assert records.read_records(records.with_starts(records.write_records(none))).count() == 0
