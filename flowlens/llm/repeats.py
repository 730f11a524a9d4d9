"""Suffix-array dedup: bytes covered by a long string that starts twice or more in the corpus are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, runs
from .arrow import pieces, raw
from .common import attach, free, new_path, remove, ship, stage
from .suffixes import repeated_windows

#: Contexts of one anchor that are sorted in one task; larger groups are dealt out to blocks of about this many.
GROUP = 2_048
#: Runs from which on the files of finished steps are waited for to go.
WAIT = 1_000_000
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of texts whose anchors are found at once.
PIECE = 2 << 20


def _anchor_rows(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, ...]:
    """runs() over any number of texts of any length: long ones are cut into ranges of windows, which changes no anchor."""
    parts = []
    lengths = np.array([len(t) for t in texts], np.int64)
    if lengths.sum() <= 2 * PIECE:
        b = np.frombuffer(b"".join(texts), np.uint8)
        return runs(b, np.cumsum(lengths) - lengths, lengths, width, seed)
    for k, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        for a in range(0, max(1, len(b) - width + 1), PIECE):
            part = b[a : a + PIECE + width - 1]
            h, c, x, at, n = runs(part, np.zeros(1, np.int64), np.array([len(part)]), width, seed)
            parts.append((h, c, x + k, at + a, n))
    return tuple(np.concatenate(x) for x in zip(*parts))


def find_anchors(docs: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(id, th, h, c, at, n) of every run of windows of the rows (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            h, c, text, at, n = _anchor_rows(raw(piece, "text"), width, seed)
            rows = pa.array(text)
            arrays = [piece.column("id").take(rows), piece.column("th").take(rows), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at, pa.int64()), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "h", "c", "at", "n"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, th long, h long, c long, at long, n int")


def _contexts(wanted: DataFrame, width: int) -> DataFrame:
    """(h, c, m, contexts, bytes) for rows (text, list of h, c, m, contexts, at, n); equal ones of a piece of texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            lists = piece.column("list")
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            at, n, h, c = (flat.field(x).to_numpy().tolist() for x in ("at", "n", "h", "c"))
            body = raw(piece, "text")
            seen: dict[tuple[int, int], bytes] = {}
            keep, cut = [], []
            for row, (k, a, w, x, y) in enumerate(zip(np.repeat(np.arange(len(body)), counts).tolist(), at, n, h, c)):
                s = body[k][a : a + w + width - 1]
                if seen.setdefault((x, y), s) is s or seen[x, y] != s:
                    keep.append(row), cut.append(s)
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(flat.field(x).take(taken) for x in ("h", "c", "m", "contexts")), pa.array(cut, pa.binary())], ["h", "c", "m", "contexts", "bytes"])

    return wanted.mapInArrow(run, "h long, c long, m long, contexts long, bytes binary")


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_RESULT = "h long, c long, ranges array<struct<a:int,b:int>>"


def _result(h: list[int], c: list[int], flags: list[np.ndarray]) -> pa.RecordBatch:
    ranges = [_ranges(f) for f in flags]
    keep = [k for k, r in enumerate(ranges) if r]
    return pa.RecordBatch.from_arrays([pa.array([h[k] for k in keep], pa.int64()), pa.array([c[k] for k in keep], pa.int64()), pa.array([ranges[k] for k in keep], _RANGE)], ["h", "c", "ranges"])


def _shards(contexts: DataFrame, width: int) -> DataFrame:
    """(h, c, ranges): the repeated windows of contexts whose anchors lie whole in a partition, in order of h and c; one suffix array takes some anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, _, flags in _sorted(batches, width, whole=True):
            yield _result(h, c, flags)

    return contexts.mapInArrow(run, _RESULT)


def _sorted(batches: Iterator[pa.RecordBatch], width: int, *, whole: bool) -> Iterator[tuple[list[int], list[int], list[bytes], list[np.ndarray]]]:
    """h, c, bytes and repeated windows of what one suffix array holds: over SHARD_BYTES by one context at most, or by what whole keeps together of an anchor."""
    h: list[int] = []
    c: list[int] = []
    m: list[int] = []
    b: list[bytes] = []
    size = 0
    for batch in batches:
        for x, y, z, s in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "m", "bytes"))):
            if size > SHARD_BYTES and not (whole and x == h[-1]):
                yield h, c, b, repeated_windows(b, m, width)
                h, c, m, b, size = [], [], [], [], 0
            h.append(x), c.append(y), m.append(z), b.append(s)
            size += len(s)
    if b:
        yield h, c, b, repeated_windows(b, m, width)


def _blocks(contexts: DataFrame, width: int) -> DataFrame:
    """The same for anchors with too many contexts for a task, which are dealt out to blocks of GROUP.

    A suffix array settles the windows that a block repeats. One hash of every other window, and of one
    of each that is settled, is then counted across blocks, combined before the shuffle. Only windows whose hash
    more than one block has meet again, by their bytes, which decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "ranges", "k", "done", "w"]
        for h, c, b, flags in _sorted(batches, width, whole=False):
            settled = _result(h, c, flags)
            n = settled.num_rows
            yield pa.RecordBatch.from_arrays([*settled.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names)
            seen: set[bytes] = set()
            rows: list[tuple[int, int, int, bool, int]] = []
            for x, y, s, f in zip(h, c, b, flags):
                for k, done in enumerate(f.tolist()):
                    window = s[k : k + width]
                    if done and window in seen:
                        continue
                    if done:
                        seen.add(window)
                    rows.append((x, y, k, done, xxhash.xxh3_64_intdigest(window) - (1 << 63)))
            for at in range(0, len(rows), 50_000):
                x, y, k, done, w = zip(*rows[at : at + 50_000])
                arrays = [pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(w), _RANGE), pa.array(k, pa.int32()), pa.array(done, pa.bool_()), pa.array(w, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    salt = F.pmod(F.xxhash64("c"), F.ceil(F.col("contexts") / GROUP))
    dealt = contexts.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt", "c").select("h", "c", "m", "bytes")
    out = stage(dealt.mapInArrow(run, _RESULT + ", k int, done boolean, w long"), "repeat-blocks")
    windows = out.where("w IS NOT NULL").select("h", "c", "k", "done", "w")
    several = windows.groupBy("w").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("w")
    maybe = windows.join(several, "w", "left_semi").drop("w").join(contexts.select("h", "c", "bytes"), ["h", "c"])
    maybe = maybe.select("h", "c", "k", "done", F.substring("bytes", F.col("k") + 1, width).alias("window"))
    twice = maybe.groupBy("window").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("window")
    more = maybe.where("NOT done").join(twice, "window", "left_semi")
    ranges = F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b")))  # each context has fewer windows than width
    return out.where("w IS NULL").select("h", "c", "ranges").unionByName(more.groupBy("h", "c").agg(ranges.alias("ranges")))


class _Clash(Exception):
    """Different contexts of one anchor share a hash."""


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200, text_out: bool = False) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, with text_out).

    Every byte that a string of width bytes covers which starts anywhere else too, in the same text or
    another, is removed; strings are judged on the input and never cross texts.

    Each window of width bytes belongs to the anchor with the lowest gram hash in it, so equal windows
    have equal anchors. Neighbouring windows with one anchor form a run, and its bytes a context. Runs are
    counted by anchor and context hash, combined before the shuffle: anchors that occur once are done. The bytes
    of all other runs are gathered by anchor and hash, and must be the same wherever the hash is; should two
    differ, all starts again with other hashes. An anchor whose occurrences all have one context repeats it as a whole. Of the
    rest one copy of each context goes to its anchor's shard, where a two-stage suffix sort puts equal
    windows side by side, and common prefixes of neighbours tell which are. Anchors with more than GROUP
    contexts are sorted in blocks, and what only blocks together repeat is compared by its bytes.

    Null texts are empty; texts shorter than width lose nothing; very long ones are worked on in parts; repeated rows are copies of each other; null
    ids are ids like any other. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    if width < GRAM:
        raise ValueError(f"width is {GRAM} bytes or more")
    ship(docs.sparkSession)
    for seed in range(8):
        try:
            return _remove(docs, id_col, text_col, width, text_out, seed)
        except _Clash:
            continue
    raise RuntimeError("contexts shared a hash eight times")


def _remove(docs: DataFrame, id_col: str, text_col: str, width: int, text_out: bool, seed: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).cast("string").alias("text"))
    path, classes_path = new_path(spark, "repeat-anchors"), new_path(spark, "repeat-classes")
    find_anchors(rows, width, seed).write.parquet(path)
    anchors = spark.read.parquet(path)
    total = anchors.count()
    anchors.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).write.parquet(classes_path)
    classes = spark.read.parquet(classes_path)
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.sum("m").alias("times")).where("times > 1")
    kept = stage(classes.join(groups.drop("times"), "h"), "repeat-kept")
    remove(spark, classes_path)
    free(spark, total > WAIT)
    # every run at an anchor that occurs twice or more; m: how many have its context, contexts: how many its anchor has
    found = attach(anchors, kept.withColumn("rows", F.col("m")), ["h", "c"], "rows", total).where("contexts IS NOT NULL")
    runs_path, contexts_path = new_path(spark, "repeat-runs"), new_path(spark, "repeat-contexts")
    found.write.parquet(runs_path)
    again = spark.read.parquet(runs_path)
    remove(spark, path)
    free(spark, total > WAIT)

    at = F.struct("h", "c", "m", "contexts", "at", "n")
    per_text = again.groupBy("id", "th").agg(F.collect_set(at).alias("list"))  # bounded by the text's length
    same = rows["id"].eqNullSafe(per_text["id"]) & (rows["th"] == per_text["th"])
    cut_ = _contexts(rows.join(per_text, same).select("text", "list"), width)
    # grouped by the bytes themselves; those of anchors with one context have been compared by then
    contexts = cut_.groupBy("h", "c", "bytes").agg(F.first("m").alias("m"), F.first("contexts").alias("contexts"))
    contexts.select("h", "c", "m", "contexts", F.when(F.col("contexts") > 1, F.col("bytes")).alias("bytes")).write.parquet(contexts_path)
    contexts = spark.read.parquet(contexts_path)
    free(spark, total > WAIT)
    several, different = contexts.agg(F.coalesce(F.max("contexts"), F.lit(0)), F.count(F.lit(1))).first()
    if different != kept.count():
        raise _Clash
    over = several > GROUP
    free(spark, total > WAIT)
    small = contexts.where((F.col("contexts") > 1) & (F.col("contexts") <= GROUP)).select("h", "c", "m", "bytes")
    found = stage(_shards(small.repartition("h").sortWithinPartitions("h", "c"), width), "repeat-sorted")
    if over:
        found = found.unionByName(stage(_blocks(contexts.where(F.col("contexts") > GROUP), width), "repeat-joined"))
    remove(spark, contexts_path)
    free(spark, total > WAIT)
    start, stop = F.col("at"), F.col("at") + (width - 1)
    whole = again.where("contexts = 1").select("id", "th", F.struct(start.alias("a"), (stop + F.col("n")).alias("b")).alias("s"))
    found = found.join(kept.select("h", "c", F.col("m").alias("rows")), ["h", "c"])
    parts = attach(again.where("contexts > 1").select("id", "th", "h", "c", "at"), found, ["h", "c"], "rows", total, wide="ranges").where("ranges IS NOT NULL")
    parts = parts.select("id", "th", F.explode(F.transform("ranges", lambda r: F.struct((start + r["a"]).alias("a"), (stop + r["b"]).alias("b")))).alias("s"))
    # a set, so that repeated rows count once; bounded by the text's length
    marks = stage(whole.unionByName(parts).groupBy("id", "th").agg(F.collect_set("s").alias("spans")), "repeat-marks")
    remove(spark, runs_path)
    free(spark, total > WAIT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            n, gone, pieces_, sha, left = [], [], [], [], []
            for text, s in zip(raw(piece, "text"), piece.column("spans").to_pylist()):
                out, at, spans = [], 0, 0
                for x in sorted(s or (), key=lambda x: x["a"]):
                    if x["a"] > at or not spans:
                        out.append(text[at : x["a"]])
                        spans += 1
                    at = max(at, x["b"])
                out.append(text[at:])
                kept = b"".join(out)
                n.append(len(text)), gone.append(len(text) - len(kept)), pieces_.append(spans), sha.append(hashlib.sha256(kept).hexdigest()), left.append(kept)
            arrays = [piece.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces_, pa.int64()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(left, pa.binary())] if text_out else [])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text_out else [])])

    same = rows["id"].eqNullSafe(marks["id"]) & (rows["th"] == marks["th"])
    joined = rows.join(marks, same, "left").select(rows["id"], "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text_out).withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; strings of 200 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
m AS (SELECT doc_id, i FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
x AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM m),
y AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM x),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM y GROUP BY doc_id, k),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS u, a AS v FROM sp UNION ALL
  SELECT doc_id, max(b), any_value(n) FROM sp JOIN d USING (doc_id) GROUP BY doc_id
), t AS (SELECT doc_id, string_agg(substr(h, CAST(2 * u + 1 AS BIGINT), CAST(2 * (v - u) AS BIGINT)), '' ORDER BY u) AS k FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM sp GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
