"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import pieces, raw
from .common import ship, stage

#: What statistics() returns for each text, in this order.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "blank", "stop", "comma", "bang", "bar", "symbol", "quote", "high",
    "word_length", "long_words", "shouted", "ending_symbols", "lone_symbols", "distinct_words", "repeats", "distinct_lines", "words_a_stop", "capital_starts",
)

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\f\v", ".;:", ",", "!?", "|", "#$%&*+/<=>@\\^_`{}~[]", "\"'()-"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 11
_SYMBOLS = b"#$%&*+/<=>@\\^_`{}~[]|!?"


@dataclass(frozen=True)
class QualityModel:
    """All that scoring needs; a few hundred kB at most, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return design(x, self.mean, self.scale, self.waves, self.phase) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.values[0])
        return np.interp(self.raw_scores(x), self.knots, self.values)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each UTF-8 text, over the whole of it."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts):
        n = max(1, len(text))
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12) / n
        words = text.split()
        w = max(1, len(words))
        lines = [x for x in text.split(b"\n") if x]
        shouted = sum(x.isupper() and len(x) > 2 for x in words)
        tails = sum(x[-1] in _SYMBOLS for x in words)
        lone = sum(len(x) == 1 and x in _SYMBOLS for x in words)
        starts = sum(x[0] < 91 and x[0] > 64 for x in words)
        repeats = sum(map(eq, words, words[1:]))
        stops = kinds[5] + kinds[7]
        row[:] = (
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *kinds[1:12],
            min(20.0, len(text) / w), sum(len(x) > 15 for x in words) / w, shouted / w, tails / w, lone / w, len(set(words)) / w, repeats / w,
            len(set(lines)) / max(1, len(lines)), np.log1p(1 / (stops * n / w + 1e-3)), starts / w,
        )
    return out


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (array of STATISTICS) of every row; null texts count as empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x = statistics(raw(piece, "text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("id"), lists], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, waves: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.hstack([np.cos(z @ waves + phase) * np.sqrt(2 / waves.shape[1]), z * 0.1, np.ones((len(z), 1))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Small batches: a row's design is ten times its statistics."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to the means y with weights n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, k in zip(y, n):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(c), v) for v, _, c in blocks]) if blocks else np.empty(0)


def _sums(rows: DataFrame, run, tasks: int) -> np.ndarray:
    """Add the arrays that run gives for each of a few partitions; the driver gets tasks arrays at most."""
    parts = rows.coalesce(tasks).mapInArrow(run, "s binary").collect()
    return sum((np.frombuffer(r.s) for r in parts), np.zeros(1))


def fit_quality(labelled: DataFrame, *, train_rows: int = 200_000, waves: int = 256, ridge: float = 1e-3, bins: int = 2048, tasks: int = 16, seed: int = 11) -> QualityModel:
    """Fit on (id, x, y), y 0 or 1; of more than train_rows rows a sample by the hash of the id is taken.

    Two thirds of the rows (by another hash of the id) give the normal equations, summed per partition;
    the rest gives the calibration, counted per bin of the ridge score. The kernel's width is the square root
    of the number of statistics. Without both labels the model is the constant share of label 1, 0.5 without any.
    """
    total, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(0, 1 / np.sqrt(d), (d, waves)), rng.uniform(0, 2 * np.pi, waves)
    constant = QualityModel(np.zeros(d), np.ones(d), w, phase, np.zeros(waves + d + 1), np.empty(0), np.array([ones / total if total else 0.5]))
    if not 0 < ones < total:
        return constant
    at = F.abs(F.xxhash64(F.col("id").cast("string"))) % 1_000_000
    rows = labelled.where(at < max(1, int(1_000_000 * min(1.0, train_rows / total))))
    rows = rows.withColumn("fit", F.abs(F.xxhash64(F.col("id").cast("string"), F.lit("fit"))) % 3 < 2)
    fit, rest = stage(rows.where("fit"), "quality-fit"), stage(rows.where("NOT fit"), "quality-rest")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((2, d + 1))
        for b in slices(batches):
            x = matrix(b)
            s += np.stack([np.append(x.sum(0), len(x)), np.append((x * x).sum(0), 0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()])], ["s"])

    s = _sums(fit, moments, tasks)
    if s.size == 1 or not s.any():
        return constant
    s = s.reshape(2, d + 1)
    mean = s[0, :d] / s[0, d]
    scale = np.sqrt(np.maximum(s[1, :d] / s[0, d] - mean**2, 1e-8))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = waves + d + 1
        a = np.zeros((size + 1, size))
        for b in slices(batches):
            z = design(matrix(b), mean, scale, w, phase)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            a[:size] += z.T @ z
            a[size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], ["s"])

    a = _sums(fit, normal, tasks).reshape(-1, waves + d + 1)
    weight = np.linalg.solve(a[:-1] + ridge * s[0, d] * np.eye(len(a) - 1), a[-1])
    model = QualityModel(mean, scale, w, phase, weight, np.empty(0), np.empty(0))
    low, step = -0.5, 2.0 / bins

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, bins))
        for b in slices(batches):
            k = np.clip((model.raw_scores(matrix(b)) - low) / step, 0, bins - 1).astype(int)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            n += np.stack([np.bincount(k, minlength=bins), np.bincount(k, y, minlength=bins)])
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], ["s"])

    n = _sums(rest, counted, tasks)
    n = n.reshape(2, bins) if n.size > 1 else np.zeros((2, bins))
    full = np.flatnonzero(n[0])
    if not len(full):
        return QualityModel(mean, scale, w, phase, weight, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    values = isotonic(n[1][full] / n[0][full], n[0][full])
    knots = low + (full + 0.5) * step
    # a little of the score itself keeps order within steps; ends are kept off 0 and 1
    values = np.clip(0.998 * values + 0.002 * np.clip(knots, 0, 1), 0, 1)
    return QualityModel(mean, scale, w, phase, weight, knots, values)


def quality_scores(docs: DataFrame, labels: DataFrame, *, train_on: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, **fit: float) -> DataFrame:
    """One row per input row: the id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= least).

    labels: (id, y); null ids and labels are left out, and an id with several labels has the smallest.
    train_on: a condition on the column id; only rows that fulfil it are learnt from. Scores depend on
    the text alone. Null and empty texts are scored by their statistics like any other, very long ones by those of the
    whole text; null ids are scored but never learnt from. Rows may repeat, and each is scored and learnt from. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    x = stage(features(docs, id_col=id_col, text_col=text_col), "quality-x")
    y = labels.toDF("lid", "y").where("lid IS NOT NULL AND y IS NOT NULL").groupBy("lid").agg(F.min("y").cast("double").alias("y"))
    model = fit_quality(x.where(train_on).join(y, F.col("id") == F.col("lid")).select("id", "x", "y"), **fit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.scores(matrix(b)))], ["id", "score"])

    scored = x.mapInArrow(score, f"id {x.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; rows whose crc32 of the id leaves 2 are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, train_on=~held_out(F.col("id")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
