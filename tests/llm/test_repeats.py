import collections
import hashlib
import random

import numpy as np
import pytest

import flowlens.llm.repeats as module
from flowlens.llm.anchors import runs
from flowlens.llm.repeats import remove_repeats
from flowlens.llm.suffixes import common_prefixes, repeated_windows, two_stage_sort


def test_two_stage_sort():
    r = random.Random(3)
    for _ in range(200):
        width, letters = r.choice([3, 5, 8]), r.choice(["ab", "abc", "aab\x00ÿ"])
        strings = ["".join(r.choices(letters, k=r.randint(width, 30))).encode("latin1") for _ in range(r.randint(1, 12))]
        counts = [r.choice([1, 1, 1, 2]) for _ in strings]
        seen = collections.Counter()
        for s, c in zip(strings, counts):
            for i in range(len(s) - width + 1):
                seen[s[i : i + width]] += c
        for s, flags in zip(strings, repeated_windows(strings, counts, width)):
            assert flags.tolist() == [seen[s[i : i + width]] > 1 for i in range(len(s) - width + 1)]
        data = b"".join(strings) + bytes(width + 1)
        wanted = np.array(sorted(r.sample(range(len(data) - width - 1), max(1, (len(data) - width - 1) // 2))))
        order = two_stage_sort(data, wanted, width)
        keys = [data[p : p + width] for p in order]
        assert keys == sorted(keys) and sorted(order) == wanted.tolist()


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    shared = bytes(r.randrange(97, 103) for _ in range(400))
    texts = [bytes(r.randrange(97, 123) for _ in range(r.randint(0, 300))) + shared + bytes(r.randrange(97, 123) for _ in range(r.randint(0, 300))) for _ in range(5)]
    lengths = np.array([len(t) for t in texts])
    h, _, text, at, n = runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, 100)
    of = {}
    for a, t, s, k in zip(h, text, at, n):
        for w in range(s, s + k):
            of.setdefault(texts[t][w : w + 100], set()).add(a)
    assert all(len(v) == 1 for v in of.values())
    assert sum(n) == sum(len(t) - 99 for t in texts if len(t) >= 100)


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + width] for _, b in texts for k in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdéf ", k=r.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(12) for _ in range(4)]
    out = [(k, prose(r.randint(0, 30)) + " ".join(r.choices(passages, k=r.randint(0, 3))) + prose(r.randint(0, 20))) for k in range(60)]
    out += [(100, None), (101, ""), (102, "x" * 500), (103, out[3][1]), (104, out[4][1]), (104, out[4][1]), (None, out[5][1]), (105, "ab" * 4000 + prose(20))]
    return out


@pytest.mark.parametrize("group", [2_048, 3])
@pytest.mark.parametrize("piece", [2 << 20, 1_000])
def test_against_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(module, "GROUP", group)
    monkeypatch.setattr(module, "PIECE", piece)
    data = rows(7)
    docs = spark.createDataFrame([(*x, 1, "h") for x in data], "doc_id long, text string, n int, h string")
    got = sorted((tuple(x) for x in remove_repeats(docs, width=50).collect()), key=repr)
    assert got == brute(data, 50)


def test_text_comes_back_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 99 + "tail"), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, width=50, text_out=True).collect()}
    assert bytes(got[1].kept) == b"tail" and bytes(got[2].kept) == b"nothing"
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, width=8)


@pytest.mark.parametrize("whole", [True, False])
def test_suffix_arrays_are_bounded(monkeypatch, whole):
    """Contexts of one anchor that share a partition: blocks are cut wherever an array is full, anchors only behind their last context."""
    sizes = []
    monkeypatch.setattr(module, "SHARD_BYTES", 5_000)
    monkeypatch.setattr(module, "repeated_windows", lambda b, m, width: sizes.append(sum(map(len, b))) or [np.zeros(len(s) - width + 1, bool) for s in b])
    r = random.Random(8)
    contexts = [bytes(r.choices(range(97, 123), k=r.randint(200, 368))) for _ in range(20 * 40)]
    keys = [(1, k) for k in range(len(contexts))]
    batch = module.pa.RecordBatch.from_arrays([module.pa.array([h for h, _ in keys]), module.pa.array([c for _, c in keys]), module.pa.array([1] * len(keys)), module.pa.array(contexts, module.pa.binary())], ["h", "c", "m", "bytes"])
    out = list(module._sorted([batch, batch.slice(0, 0)], 200, whole=whole))
    assert sum(len(x[0]) for x in out) == len(contexts)
    assert (len(sizes) == 1) if whole else max(sizes) <= 5_000 + 368


def test_blocks_compare_bytes(spark, monkeypatch):
    """One hot anchor in many blocks, with a hash of windows that takes all for equal."""
    monkeypatch.setattr(module, "GROUP", 4)
    monkeypatch.setattr(module, "SHARD_BYTES", 600)
    r = random.Random(9)
    mid = "".join(r.choices("abcdefgh", k=40))
    side = ["".join(r.choices("xyz", k=30)) for _ in range(6)]
    texts = [(k, r.choice(side) + mid + r.choice(side)) for k in range(50)]
    monkeypatch.setattr(module.xxhash, "xxh3_64_intdigest", lambda b, seed=0, f=module.xxhash.xxh3_64_intdigest: f(b, seed) if len(b) != 64 else 1 << 63)
    got = sorted((tuple(x) for x in remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), width=64).collect()), key=repr)
    assert got == brute(texts, 64)


def test_contexts_that_share_a_hash(spark, monkeypatch):
    """Equal hashes of different bytes are seen, and other hashes are tried."""
    tried = []

    def weak(docs, width, seed=0):
        tried.append(seed)
        out = find(docs, width, seed)
        return out.withColumn("c", module.F.lit(7).cast("long")) if seed == 0 else out

    find = module.find_anchors
    monkeypatch.setattr(module, "find_anchors", weak)
    data = rows(5)
    got = sorted((tuple(x) for x in remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), width=40).collect()), key=repr)
    assert got == brute(data, 40) and tried == [0, 1]


def test_common_prefixes():
    r = random.Random(10)
    for width in (5, 8, 13, 200):
        data = "".join(r.choices("ab", k=300)).encode() + b"ab" * 150 + bytes(width + 8)
        order = np.array(sorted(range(600 - width), key=lambda p: data[p : p + width]))
        slow = [next((k for k in range(width) if data[a + k] != data[b + k]), width) for a, b in zip(order, order[1:])]
        assert common_prefixes(data, order, width).tolist() == slow
