"""The rebuilt model against the sentencepiece library, text by text."""

import random

import numpy as np
import pytest
from filetrail.llm import pieces
from filetrail.llm.common import table
from filetrail.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH)


def ids_of(encoder, texts):
    return [np.frombuffer(i, encoder.dtype).tolist() for i in encoder.encode(texts)[0]]


def test_random_texts_agree(encoder):
    rnd = random.Random(4)
    letters = [*"abz AZ  0129\n\t.,!é日🙂▁　\x00\x85", "<s>", "<unk>", "<0x0A>", "the ", " in", "    "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    got = ids_of(encoder, texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == encoder.library.encode(text), repr(text)
    assert all(encoder.encode(texts)[1])
    for text, ids in zip(texts, encoder.encode(texts)[0], strict=True):
        assert encoder.decode(ids) == text.replace("▁", " ")


def test_decoding_any_ids(encoder):
    rnd = random.Random(5)
    for _ in range(500):
        ids = [rnd.randrange(3, 32000) for _ in range(8)]
        assert encoder.decode(np.array(ids, encoder.dtype).tobytes()) == encoder.library.decode(ids)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in pieces.encode_documents(docs, keep_ids=True).collect()}
    library = pieces.PieceEncoder.of(PATH).library
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == library.encode(r.text)
        assert got[r.doc_id].round_trip and got[r.doc_id].parity


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a  b \n\n c ", None), (4, "long " * 30_000, "x"), (4, "w" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_documents(df).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and all(r.round_trip and r.parity for r in got)
    assert pieces.encode_documents(df.limit(0)).count() == 0


def test_unigram_models_are_rebuilt():
    model = pieces.Model([("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1)], pieces.UNIGRAM, False, b"", True, False)
    assert model.tokenizer().encode("▁ab").ids == [1] and model.tokenizer().encode("▁a").ids == [2]
