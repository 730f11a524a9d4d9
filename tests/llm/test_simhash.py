import random
import re

import numpy as np
import pytest
import xxhash

import flowlens.llm.simhash as module
from flowlens.llm.components import components
from flowlens.llm.simhash import HALVES, build_tree, distance, fingerprint, place, simhash_components, spanning_edges


def slow_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "one", "One two", "a b c", "É é E e\x1cx y z", "b b b b b", "w " * 40_000, "the The\tthe\nthe"])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 3, 42) == slow_fingerprint(text)


def forest(fps, reach):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps) <= reach):
            parent[find(int(b))] = find(a)
    return [find(k) for k in range(len(fps))]


def clustered(seed, centres, near):
    r = random.Random(seed)
    out = []
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(near):
            x = c
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_bring_every_close_pair_together(seed):
    fps = clustered(seed, 150, 6)
    trees = [(m, build_tree(fps[:: 3], m, 8)) for m in HALVES]
    met = set()
    for mask, tree in trees:
        row, leaf, ghost = place(fps, tree, mask, 1)
        assert sorted(row[~ghost]) == list(range(len(fps)))  # one home each
        for k in np.unique(leaf):
            home, every = row[(leaf == k) & ~ghost], row[leaf == k]
            met |= {(min(a, b), max(a, b)) for a in home for b in every}
    for a in range(len(fps)):
        for b in np.flatnonzero(distance(fps[a], fps, (1 << 64) - 1) <= 3):
            assert a == b or (min(a, b), max(a, b)) in met


def test_spanning_edges_of_dense_leaf_are_few():
    base = random.Random(5).getrandbits(64)
    fps = np.array([base ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a)], np.uint64)
    a, b = spanning_edges(fps, fps[:0], 3)
    assert len(a) <= 8 * len(fps)
    index = {int(f): k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b):
        parent[find(index[int(x)])] = find(index[int(y)])
    assert len({find(k) for k in range(len(fps))}) == len(set(forest(fps, 3)))


def check_components(spark, monkeypatch, fps):
    order = np.random.default_rng(1).permutation(len(fps))
    rows = [(int(k), int(fps[k].view(np.int64))) for k in order]
    rows += [(k + 100_000, f) for k, f in rows[:40]] + [(None, rows[0][1])]
    monkeypatch.setattr(module, "fingerprints", lambda docs, **_: docs.selectExpr("doc_id AS id", "fp"))
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    roots = forest(fps, 3)
    least = {}
    for k, root in enumerate(roots):
        least[root] = min(k, least.get(root, k))
    value = {int(f): k for k, f in enumerate(fps)}
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == least[roots[value[int(r.fingerprint, 16)]]]


@pytest.mark.parametrize("leaf", [4, 512])
def test_components_of_planted_fingerprints(spark, monkeypatch, leaf):
    monkeypatch.setattr(module, "LEAF", leaf)
    check_components(spark, monkeypatch, clustered(9, 80, 5))


def small_limits(monkeypatch, **limits):
    for name, value in {"LEAF": 16, "SAMPLE": 256, "VISITORS": 64, "CHUNK": 300, **limits}.items():
        monkeypatch.setattr(module, name, value)


def sharing_a_half(n, seed=6):
    r = random.Random(seed)
    half = r.getrandbits(32) << 32
    near = [half | f for f in (r.getrandbits(32) for _ in range(n))]
    near += [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in near[::9]]
    return np.unique(np.array(near + [r.getrandbits(64) for _ in range(n // 3)], np.uint64))


@pytest.mark.parametrize("rounds", [6, 0])
def test_over_full_leaves_are_divided(spark, monkeypatch, rounds):
    """A hot half: the trees divide what they can, and what is left over is compared in blocks; no link is lost."""
    small_limits(monkeypatch, ROUNDS=rounds)
    fps = sharing_a_half(1_500)
    table = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    placed = module.leaves(table, len(fps), 3)
    homes = placed.where("NOT ghost").groupBy("view", "fp").count()
    assert homes.count() == 2 * len(fps) and homes.where("count > 1").isEmpty()
    cell = module.cells(placed).groupBy("shard", "block", "part").agg({"ghost": "count"}).agg({"count(ghost)": "max"}).first()[0]
    assert cell <= 4 * (4 * 16 + 64)  # dealt by hash, so about a block and a part
    check_components(spark, monkeypatch, fps)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "same words here", "c"), (3, "same words here", "c"), (4, "Same WORDS here", None), (None, None, None)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    f = f"{slow_fingerprint('same words here'):016x}"
    assert got == {(1, "0" * 16, 1), (2, "0" * 16, 1), (None, "0" * 16, 1), (3, f, 3), (4, f, 3)}
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_chain_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, 6), (7, 6), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(201)} == {0}
    assert {got[k] for k in range(1000, 1300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
