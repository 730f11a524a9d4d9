import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm.quality import STATISTICS, fit_quality, held_out, isotonic, op3_quality, quality_scores, statistics


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["an", "er", "th", "on", "re", "ti"], k=r.randint(1, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        y = int(r.random() < 0.7)
        text = " ".join(w + ("." if r.random() < 0.1 else "") for w in words) if y else r.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + r.choice(["%%%", "$$$"]) for w in words), f"{words[0]} " * len(words)])
        rows.append((k, text, y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(docs, labels, train_on=~held_out(F.col("id"))).collect()}
    held = [r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()]
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    rows = corpus(60)
    more = [(None, "no id"), (100, None), (101, ""), (102, "x" * 300_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels, train_on=F.lit(True)).collect()
    assert len(got) == len(rows) + len(more) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert quality_scores(docs.limit(0), labels, train_on=F.lit(True)).count() == 0


def test_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none, train_on=F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, one, train_on=F.lit(True)).collect()} == {1.0}


def test_two_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "X!! Y!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, labels, train_on=F.lit(True)).collect())


def test_sample_is_bounded(spark):
    rows = corpus(300)
    x = statistics([t.encode() for _, t, _ in rows]).astype(float)
    labelled = spark.createDataFrame([(i, v.tolist(), float(y)) for (i, _, y), v in zip(rows, x)], "id long, x array<float>, y double")
    model = fit_quality(labelled, train_rows=150, waves=32)
    assert model.waves.shape == (len(STATISTICS), 32)


def test_isotonic():
    assert isotonic(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0, 3.0])).tolist() == [0.5, 0.5, 1.25, 1.25]
    assert isotonic(np.array([]), np.array([])).tolist() == []


def test_statistics_cover_the_whole_text():
    head = b"calm words here. " * 1000
    a, b = statistics([head, head + b"@@@ ### $$$ " * 1000])
    assert b[STATISTICS.index("symbol")] > 0.2 > a[STATISTICS.index("symbol")]


def slow_isotonic(y, n):
    """The greatest lower mean of upper means, by its definition."""
    out = []
    for i in range(len(y)):
        out.append(max(min(np.average(y[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)))
    return np.array(out)


def test_query_against_direct_ridge_and_isotonic(spark, tmp_path):
    """op3_quality against one numpy fit over all rows: the same features, the kernel system solved at once, isotonic values by definition."""
    import zlib

    rows = corpus(500, seed=8) + [(1_000, None, 1), (1_001, "", 0), (1_002, "calm words. " * 20_000, 1)]
    spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, predicted string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op3_quality(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    x = statistics([(t or "").encode() for _, t, _ in rows]).astype(np.float32).astype(float)
    # which rows fit and which calibrate is the operator's own choice, by hash of the id
    draw = spark.createDataFrame([(i,) for i, _, _ in rows], "id long").select("id", (F.abs(F.xxhash64(F.col("id").cast("string"), F.lit("fit"))) % 3 < 2).alias("fit")).collect()
    use = {r.id: r.fit for r in draw}
    fit = np.array([not held[i] and use[i] for i, _, _ in rows])
    rest = np.array([not held[i] and not use[i] for i, _, _ in rows])
    y = np.array([v for _, _, v in rows], float)
    mean, scale = x[fit].mean(0), np.sqrt(np.maximum(x[fit].var(0), 1e-8))
    rng = np.random.default_rng(11)
    d = len(STATISTICS)
    waves, phase = rng.normal(0, 1 / np.sqrt(d), (d, 256)), rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - mean) / scale, -4, 4)
    z = np.hstack([np.sqrt(2 / 256) * np.cos(z @ waves + phase), 0.1 * z, np.ones((len(z), 1))])
    lam = 1e-3 * fit.sum()
    kernel = z[fit] @ z[fit].T  # the dual system, where the operator solves the primal one
    raw = z @ (z[fit].T @ np.linalg.solve(kernel + lam * np.eye(fit.sum()), y[fit]))
    step = 2.0 / 2048
    bin_ = np.clip((raw + 0.5) / step, 0, 2047).astype(int)
    full = np.unique(bin_[rest])
    n = np.array([(bin_[rest] == b).sum() for b in full], float)
    share = np.array([y[rest][bin_[rest] == b].mean() for b in full])
    knots = -0.5 + (full + 0.5) * step
    values = np.clip(0.998 * slow_isotonic(share, n) + 0.002 * np.clip(knots, 0, 1), 0, 1)
    expected = np.interp(raw, knots, values)
    off = [abs(got[i].score - e) for (i, _, _), e in zip(rows, expected)]
    assert np.mean(np.array(off) < 1e-4) > 0.99 and max(off) < 0.05  # a score at a bin's edge may fall to its neighbour
    assert all(got[i].held_out == held[i] and got[i].predicted == int(got[i].score >= 0.7) for i, _, _ in rows)
    assert np.mean([got[i].predicted == v for i, _, v in rows if held[i]]) > 0.95
