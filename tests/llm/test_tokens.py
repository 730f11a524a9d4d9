import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import flowlens.llm.unit_encoder as module
from flowlens.llm.tokens import read_index, read_tokens, write_tokens
from flowlens.llm.unit_encoder import UnitEncoder

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    ids, counts = encoder.encode(b"".join(data), np.array([len(d) for d in data]), 2)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_units_give_the_ids_of_whole_texts():
    r = random.Random(5)
    parts = ["a", "word", "b", "é", "日", ".", ",", "'s", " ", "  ", "\n", "\u00a0", "\u3000", "\u2009", "\x85", "\x1f", "1", "²", "<|endoftext|>", "'", "\u0301", "\t", "ⅷ", "“", "averylongwordthatisnotremembered"]
    texts = ["", " ", "\n", "don't stop, now.", "1,000. x", "x \ny", "x  y", "é a"] + ["".join(r.choices(parts, k=r.randint(0, 20))) for _ in range(4000)]
    plain, encoder = Tokenizer.from_file(VOCAB), UnitEncoder(VOCAB)
    for at in range(0, len(texts), 500):
        for t, got in zip(texts[at : at + 500], encoded(encoder, texts[at : at + 500])):
            assert got == plain.encode(t, add_special_tokens=False).ids + [2], repr(t)
    assert encoded(encoder, ["", "", ""]) == [[2], [2], [2]]


def test_other_tokenizers_see_whole_texts():
    """One that lower-cases, splits by its own pattern and closes words: nothing is cut, and the ids are the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), UnitEncoder(path)
    texts = ["Hello  World, don't stop. Now", "", " é A\u0301 ", "x" * 30 + " y. Z", "<|endoftext|>a.b", "Hello  World, don't stop. Now"]
    assert not encoder.cuts and UnitEncoder(VOCAB).cuts
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_small_memory(monkeypatch):
    monkeypatch.setattr(module, "MEMORY", 5)
    encoder, plain = UnitEncoder(VOCAB), Tokenizer.from_file(VOCAB)
    for t in ["a b c d e f g", "h i j a b", "a b, c."] * 2:
        assert encoded(encoder, [t]) == [plain.encode(t, add_special_tokens=False).ids + [2]]


def test_files(spark, tmp_path):
    rows = [(5, "five words are in here"), (3, None), (9, ""), (7, "long " * 50_000), (3, "again"), (None, "no id"), (1, "One.")]
    docs = spark.createDataFrame([(*x, "p", 1) for x in rows], "doc_id long, text string, part string, seq int")
    path = f"file://{tmp_path}/t"
    write_tokens(docs, path, vocab=VOCAB, end_id=2)
    plain = Tokenizer.from_file(VOCAB)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start = 0
    got = read_index(spark, path).orderBy("start").collect()
    for (i, t), r in zip(ordered, got, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in read_tokens(spark, path, 4, 8).collect()} == {5, 7}
    assert read_tokens(spark, path, 5, 5).first().ids == plain.encode(rows[0][1], add_special_tokens=False).ids + [2]


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocab=VOCAB, end_id=2)
    assert read_index(spark, path).count() == 0
