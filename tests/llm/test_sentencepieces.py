import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from flowlens.llm.pieces_model import PieceModel
from flowlens.llm.sentencepieces import decode_pieces, default_model, encode_pieces, piece_digest

TEXTS = ["", " ", "  ", "a", " a", "a ", "▁a", "a▁▁ b", "\n\n x\t", "日本語テキスト 🎉 é", "a\x00b", "x" * 500, "ab" * 300 + " " + "ü" * 250, "<s> </s> <unk> <0x41>"]
_r = random.Random(2)
TEXTS += ["".join(_r.choices("abcde  \n▁éß日🎉the ing", k=_r.randint(0, 60))) for _ in range(1500)]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture(scope="module")
def proto():
    with open(default_model(), "rb") as f:
        return f.read()


def test_bpe_equals_the_library(proto):
    model, library = PieceModel(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t, got in zip(TEXTS, model.encode(TEXTS)):
        expected = library.encode(t)
        assert ids(got) == expected, repr(t)
        assert model.decode(np.array(expected, int)) == library.decode(expected)


def test_unigram_viterbi_reaches_the_library_scores(proto):
    m = pb.ModelProto()
    m.ParseFromString(proto)
    m.trainer_spec.model_type = 1
    rng = random.Random(4)
    for p in m.pieces:
        if p.type == 1:
            p.score = -rng.uniform(3, 15)
    model, library = PieceModel(proto=m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())

    def total(found):  # the same pieces in another order add up to the same
        return sum(float(model.score[k]) for k in found)

    for t, got in zip(TEXTS, model.encode(TEXTS)):
        expected = library.encode(t)
        assert library.decode(ids(got)) == library.decode(expected)
        assert total(ids(got)) == pytest.approx(total(expected), abs=1e-3), repr(t)


def test_small_memory(proto, monkeypatch):
    import flowlens.llm.pieces_model as module

    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    model, library = PieceModel(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t in TEXTS[:100]:
        assert ids(model.encode([t])[0]) == library.encode(t)


def test_tables(spark):
    rows = [(1, "hello  world"), (1, "hello  world"), (2, None), (3, ""), (None, "no id"), (4, "word " * 50_000 + "z" * 20_000)]
    docs = spark.createDataFrame([(*x, [1], "r") for x in rows], "doc_id long, text string, ids array<int>, restored string")
    encoded = encode_pieces(docs, model=default_model())
    back = decode_pieces(encoded, model=default_model()).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    digest = piece_digest(docs, model=default_model()).collect()
    assert len(digest) == len(rows) and all(r.restored for r in digest)
    assert piece_digest(docs.limit(0), model=default_model()).count() == 0
    unset = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_pieces(unset, model=default_model()).first().text == ""


def test_decoding_tables(spark):
    """Null lists and nulls in them, repeated rows, more rows than are decoded at once, columns with clashing names."""
    from pyspark.sql import functions as F

    texts = [(k, f"word {k} é") for k in range(700)] + [(None, "x"), (5, "word 5 é"), (900, None), (901, "long " * 60_000)]
    docs = spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id long, text string, ids string, id int").coalesce(1)
    encoded = encode_pieces(docs, model=default_model())
    back = decode_pieces(encoded.withColumn("text", F.lit("other")), model=default_model()).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted([(i, t or "") for i, t in texts], key=repr)
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in decode_pieces(odd, model=default_model()).collect()] == ["", "", ""]
    both = piece_digest(docs, model=default_model(), with_ids=True)
    assert both.where(F.size("ids") != F.col("n_pieces")).isEmpty() and both.where("restored").count() == len(texts)
