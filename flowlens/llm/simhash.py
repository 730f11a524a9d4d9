"""SimHash near-dedup: 64-bit fingerprints, linked through vantage-point trees of the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import pieces, raw
from .common import attach, ship, stage
from .components import components

#: Fingerprints from which one tree is built, at most; every fingerprint is then placed in it.
SAMPLE = 65_536
#: Fingerprints a leaf should hold; one with over four times as many is divided by a tree of its own.
LEAF = 2_048
#: Visitors of a leaf that one task compares with those at home there.
VISITORS = 65_536
#: Rows of an over-full leaf that one task places in its tree.
CHUNK = 200_000
#: How often over-full leaves are divided.
ROUNDS = 6
#: Bits in which the trees measure: two fingerprints at distance k or less differ in at most k // 2 bits of one half.
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The SimHash of a text's word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: both act on ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = zip(*(words[i : i + n] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        part = hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """id, fp (the 64 bits as a signed long) of every row; null texts count as empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in raw(piece, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask)).astype(np.int16)


def build_tree(sample: np.ndarray, mask: int, leaf: int, seed: int = 7) -> dict[str, np.ndarray]:
    """A vantage-point tree over the sample: node k has a vantage point, a radius and two children (-1 - leaf number)."""
    rng = np.random.default_rng(seed)
    vantage, radius, child, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
    while todo:
        points, parent, side = todo.pop()
        cut = _cut(points, mask, rng) if len(points) > leaf else None
        if cut is None:
            at, leaves = -1 - leaves, leaves + 1
        else:
            at = len(vantage)
            v, r, d = cut
            vantage.append(v), radius.append(r), child.append([0, 0])
            todo += [(points[d <= r], at, 0), (points[d > r], at, 1)]
        if parent >= 0:
            child[parent][side] = at
    return {"vantage": np.array(vantage, np.uint64), "radius": np.array(radius, np.int16), "child": np.array(child, np.int32).reshape(-1, 2)}


def _cut(points: np.ndarray, mask: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point, of a few, whose radius halves the points with the fewest of them near the border."""
    best = None
    for v in points[rng.integers(0, len(points), 5)]:
        d = distance(points, v, mask)
        count = np.bincount(d, minlength=65)
        below = np.cumsum(count)[:-1] / len(points)
        cost = np.abs(below - 0.5) + 0.5 * (count[:-1] + count[1:]) / len(points)
        cost[(below == 0) | (below == 1)] = 9
        r = int(np.argmin(cost))
        if cost[r] < 9 and (best is None or cost[r] < best[0]):
            best = (cost[r], v, r, d)
    return best and best[1:]


def place(fps: np.ndarray, tree: dict[str, np.ndarray], mask: int, reach: int, ghosts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, ghost): each row's home leaf, and as a ghost each leaf behind a border that its ball of radius reach crosses.

    By the triangle bound a point inside the radius r of a vantage point can only be within reach of
    points at distance r + reach or less. One of a pair finding the other is enough, so home rows send
    ghosts inwards only; ghosts, also those that come as such, spread both ways.
    """
    rows, ghost = np.arange(len(fps)), np.zeros(len(fps), bool) if ghosts is None else ghosts
    if not len(tree["vantage"]):
        return rows, np.zeros(len(fps), np.int32), ghost
    node, out = np.zeros(len(fps), np.int32), []
    while len(rows):
        d, r = distance(fps[rows], tree["vantage"][node], mask), tree["radius"][node]
        near, far = tree["child"][node, 0], tree["child"][node, 1]
        inside = d <= r
        home_in, home_out, over = ~ghost & inside, ~ghost & ~inside, ~ghost & ~inside & (d - reach <= r)
        g_in, g_out = ghost & (d - reach <= r), ghost & (d + reach > r)
        parts = [(home_in, near, False), (home_out, far, False), (over | g_in, near, True), (g_out, far, True)]
        rows_, node_, ghost_ = (np.concatenate(x) for x in zip(*((rows[m], to[m], np.full(m.sum(), g)) for m, to, g in parts)))
        done = node_ < 0
        out.append((rows_[done], -1 - node_[done], ghost_[done]))
        rows, node, ghost = rows_[~done], node_[~done], ghost_[~done]
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def spanning_edges(home: np.ndarray, ghosts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that lie within reach of each other, not all such pairs: a dense leaf gives a few per point."""
    label, a, b = np.arange(len(home)), [], []
    pairs = None
    if len(home) <= 2048:
        pairs = np.nonzero(np.triu(np.bitwise_count(home[:, None] ^ home[None, :]) <= reach, 1))
    if pairs is not None and len(pairs[0]) <= 8 * len(home):
        a.append(home[pairs[0]]), b.append(home[pairs[1]])
    else:  # flood: what a point has reached is not compared again
        left = label.copy()
        while len(left):
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                hit = np.bitwise_count(home[left] ^ home[queue.pop()]) <= reach
                queue += left[hit].tolist()
                label[left[hit]] = root
                left = left[~hit]
        a.append(home), b.append(home[label])
    step = max(1, (1 << 21) // max(1, len(home)))
    for at in range(0, len(ghosts), step):
        g, h = np.nonzero(np.bitwise_count(ghosts[at : at + step, None] ^ home[None, :]) <= reach)
        if len(g):
            g, h = np.unique(np.stack([g + at, label[h]]), axis=1)
            a.append(ghosts[g]), b.append(home[h])
    return np.concatenate(a) if a else home[:0], np.concatenate(b) if b else home[:0]


def _sampled(share: Column, seed: int) -> Column:
    """Whether a fingerprint is in the hash sample of a share."""
    return F.xxhash64(F.lit(seed), "fp").bitwiseAND(F.lit((1 << 62) - 1)) < share * F.lit(float(1 << 62))


_PLACED = "shard long, view int, fp long, ghost boolean"


def leaves(fps: DataFrame, total: int, reach: int) -> DataFrame:
    """(shard, view, fp, ghost): the distinct fingerprints in the leaves of two trees, one for each half of the bits.

    The first trees come from a sample on the driver. A leaf that holds too many is divided by a tree of its own,
    built from a sample of the leaf by an executor and applied to the leaf's rows in chunks, until none does: so
    leaves multiply with the fingerprints, and no task holds more than a sample or a chunk.
    """
    bits = np.array([r[0] for r in fps.select("fp").where(_sampled(F.lit(min(0.25, SAMPLE / max(1, total))), 1)).limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    most = max(8, int(LEAF * len(bits) / max(1, total)))
    trees = [build_tree(np.sort(bits), mask, most) for mask in HALVES]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(x), 20_000):
                part = x[at : at + 20_000]
                for view, (mask, tree) in enumerate(zip(HALVES, trees)):
                    row, leaf, ghost = place(part, tree, mask, reach // len(HALVES))
                    for k in range(0, len(row), 500_000):
                        cut = slice(k, k + 500_000)
                        n = len(row[cut])
                        arrays = [pa.array(leaf[cut].astype(np.int64) * len(HALVES) + view), pa.array(np.full(n, view, np.int32)), pa.array(part[row[cut]].view(np.int64)), pa.array(ghost[cut])]
                        yield pa.RecordBatch.from_arrays(arrays, ["shard", "view", "fp", "ghost"])

    placed = stage(fps.select("fp").mapInArrow(spread, _PLACED), "simhash-leaves")
    for _ in range(ROUNDS):
        sizes = placed.groupBy("shard").agg(F.count_if(~F.col("ghost")).alias("homes"), F.count(F.lit(1)).alias("rows"))
        over = stage(sizes.where(F.col("homes") > 4 * LEAF), "simhash-over")
        if over.isEmpty():
            break
        placed = stage(_divided(placed, over, reach), "simhash-leaves")
    return placed


def _divided(placed: DataFrame, over: DataFrame, reach: int) -> DataFrame:
    """placed with the leaves in over (shard, homes, rows) divided by a tree each."""

    def build(leaf: pd.DataFrame) -> pd.DataFrame:
        points, view = np.sort(leaf["fp"].to_numpy().view(np.uint64)), int(leaf["view"].iloc[0])
        most = max(8, int(LEAF * len(points) / int(leaf["homes"].iloc[0])))
        mask = HALVES[view]
        tree = build_tree(points, mask, most)
        if not len(tree["vantage"]):  # all are equal in this half, so that only the other one can part them
            mask, view = (1 << 64) - 1, -1
            tree = build_tree(points, mask, most)
        arrays = [tree[x].tobytes() for x in ("vantage", "radius", "child")]
        return pd.DataFrame([(int(leaf["shard"].iloc[0]), view, *arrays)], columns=["shard", "by", "vantage", "radius", "child"])

    def down(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(trees):
            return rows[["shard", "view", "fp", "ghost"]]
        t = trees.iloc[0]
        tree = {"vantage": np.frombuffer(t["vantage"], np.uint64), "radius": np.frombuffer(t["radius"], np.int16), "child": np.frombuffer(t["child"], np.int32).reshape(-1, 2)}
        mask, near = ((1 << 64) - 1, reach) if t["by"] < 0 else (HALVES[t["by"]], reach // len(HALVES))
        fps = rows["fp"].to_numpy().view(np.uint64)
        row, leaf, ghost = place(fps, tree, mask, near, rows["ghost"].to_numpy(bool))
        # two leaves that share a number by chance only compare more
        shard = (np.uint64(int(key[0]) % (1 << 64)) ^ (leaf.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        shard ^= shard >> np.uint64(29)
        return pd.DataFrame({"shard": shard.view(np.int64), "view": rows["view"].to_numpy()[row], "fp": fps[row].view(np.int64), "ghost": ghost})

    chunks = F.ceil(F.col("rows") / CHUNK)
    inside = placed.join(over, "shard")
    sample = inside.where(~F.col("ghost") & _sampled(F.least(F.lit(1.0), F.lit(SAMPLE / 4) / F.col("homes")), 2))
    trees = stage(sample.groupBy("shard").applyInPandas(build, "shard long, by int, vantage binary, radius binary, child binary"), "simhash-trees")
    copies = trees.join(over.select("shard", chunks.alias("chunks")), "shard")
    copies = copies.select("shard", "by", "vantage", "radius", "child", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = inside.select("shard", "view", "fp", "ghost", F.pmod(F.xxhash64(F.lit(3), "fp"), chunks).alias("chunk"))
    moved = dealt.groupBy("shard", "chunk").cogroup(copies.groupBy("shard", "chunk")).applyInPandas(down, _PLACED)
    return placed.join(over, "shard", "left_anti").unionByName(moved)


def cells(placed: DataFrame) -> DataFrame:
    """(shard, block, part, fp, ghost): what one task compares, as a leaf's homes in blocks by its visitors in parts.

    Nearly all leaves are one cell. Blocks past the first are of leaves that no tree could divide; there the homes of
    later blocks visit the earlier ones.
    """
    sizes = placed.groupBy("shard").agg(F.count_if(~F.col("ghost")).alias("homes"), F.count_if("ghost").alias("ghosts"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("homes") / (4 * LEAF)))
    visitors = F.col("ghosts") + F.when(blocks > 1, F.col("homes")).otherwise(0)
    sizes = sizes.select("shard", blocks.cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(visitors / VISITORS)).cast("int").alias("parts"))
    rows = placed.join(sizes, "shard")
    one = rows.where("blocks = 1 AND parts = 1").select("shard", F.lit(0).alias("block"), F.lit(0).alias("part"), "fp", "ghost")
    block, part = F.pmod(F.xxhash64(F.lit(4), "fp"), "blocks").cast("int"), F.pmod(F.xxhash64(F.lit(5), "fp"), "parts").cast("int")
    many = rows.where("blocks > 1 OR parts > 1").withColumns({"own": block, "part": part})
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    home = many.where(~F.col("ghost")).select("shard", F.col("own").alias("block"), F.explode(upto(F.col("parts"))).alias("part"), "fp", "ghost")
    later = many.where(~F.col("ghost") & (F.col("own") > 0)).select("shard", F.explode(upto(F.col("own"))).alias("block"), "part", "fp", F.lit(True).alias("ghost"))
    guests = many.where("ghost").select("shard", F.explode(upto(F.col("blocks"))).alias("block"), "part", "fp", "ghost")
    return one.unionByName(home).unionByName(later).unionByName(guests)


def link_fingerprints(fps: DataFrame, total: int, reach: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints at distance reach or less."""

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        x, ghost = cell["fp"].to_numpy().view(np.uint64), cell["ghost"].to_numpy()
        a, b = spanning_edges(x[~ghost], x[ghost], reach)
        keep = a != b
        return pd.DataFrame({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    return cells(leaves(fps, total, reach)).groupBy("shard", "block", "part").applyInPandas(link, "a long, b long")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, reach: int = 3) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Equal fingerprints collapse first, combined before the shuffle, so groups of copies of any size enter
    the search once. Two vantage-point trees, one for each half of the bits, partition the distinct
    fingerprints: of two at distance reach or less, one half differs in reach // 2 bits or fewer, so that
    tree brings them into a leaf together (borders are bridged by ghosts), where all 64 bits are compared.
    The trees come from bounded samples; every fingerprint is placed, so no link is lost.

    Null and empty texts have fingerprint zero, linked like any other; very long texts are hashed in parts. Repeated rows
    are copies. Null ids get a component, but none is named after them unless it has no other id. Empty tables give no rows;
    other columns, whatever their names, are not read.
    """
    if not 0 <= reach < 64:
        raise ValueError("reach is a number of bits")
    marked = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "simhash-fp")
    classes = stage(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least")), "simhash-classes")
    distinct, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    roots = components(link_fingerprints(classes, distinct, reach)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    by_fp = attach(rooted.select("fp", "rows", "root"), named, ["root"], "fps", distinct).drop("root")
    out = attach(marked, stage(by_fp, "simhash-named"), ["fp"], "rows", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: three-word shingles, links at three differing bits or fewer."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
