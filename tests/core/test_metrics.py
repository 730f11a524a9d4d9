import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics


def scored(spark, labels, scores):
    return spark.createDataFrame([(k, y, s) for k, (y, s) in enumerate(zip(labels, scores))], "k long, label int, score double")


def test_golden_values(spark):
    s = scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.8, 0.2])
    r = metrics.evaluate(s, tie=F.col("k"), budgets=[2], fractions=[0.25]).first()
    assert r.average_precision == pytest.approx(5 / 6) and r.roc_auc == 0.75
    assert (r.threshold_precision, r.threshold_recall, r.threshold_f1, r.threshold_false_positive_rate) == (0.5, 0.5, 0.5, 0.5)
    assert (r.precision_at_2, r.recall_at_2, r.lift_at_2, r.precision_at_1) == (0.5, 0.5, 1.0, 1.0)


def test_ties_by_position_and_no_alerts(spark):
    assert metrics.at_k(scored(spark, [1, 0], [0.5, 0.5]), [1], tie=F.col("k")).first().precision == 1.0
    r = metrics.threshold_metrics(scored(spark, [0, 1], [0.1, 0.2])).first()
    assert (r.threshold_precision, r.threshold_recall, r.threshold_f1, r.threshold_accuracy) == (0, 0, 0, 0.5)


def test_ranking_against_pairs(spark):
    r = random.Random(5)
    labels, scores = [r.randint(0, 1) for _ in range(300)], [r.randint(0, 40) / 40 for _ in range(300)]
    got = metrics.ranking_metrics(scored(spark, labels, scores)).first()
    pos, neg = ([s for y, s in zip(labels, scores) if y == v] for v in (1, 0))
    assert got.roc_auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    ap = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for s in scores) for t in set(scores))
    assert got.average_precision == pytest.approx(ap)


def test_counts_add_up(spark):
    s = scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.8, 0.2])
    parts = metrics.confusion(s.where("k < 2"), 0.5).unionByName(metrics.confusion(s.where("k >= 2"), 0.5))
    total = parts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
    assert metrics.rates(total).first() == metrics.threshold_metrics(s).first()


def test_bad_arguments(spark):
    s = scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.8, 0.2])
    for budgets in ([], [0], [2, 2], [9]):
        with pytest.raises(ValueError):
            metrics.at_k(s, budgets, tie=F.col("k"))
    for fraction in (0, 1.5):
        with pytest.raises(ValueError):
            metrics.budget_size(fraction, 10)
    with pytest.raises(ValueError):
        metrics.evaluate(s.where("label = 1"), tie=F.col("k"))
    with pytest.raises(ValueError):
        metrics.evaluate(s, tie=F.col("k"), budgets=[1], fractions=[0.25])
    with pytest.raises(ValueError):
        metrics.at_k(s.where("label = 0"), [1], tie=F.col("k"))
    assert metrics.budget_size(0.21, 10) == 3


@pytest.mark.parametrize("labels, scores", [([0, 2, 1, 0], [0.1, 0.2, 0.3, 0.4]), ([0, 1, 1, 0], [0.1, float("nan"), 0.3, 0.4]), ([0, 1, None, 0], [0.1, 0.2, 0.3, 0.4]), ([0, 1], [None, 0.5]), ([0, 1], [float("inf"), 0.5]), ([], [])])
def test_bad_input_is_refused(spark, labels, scores):
    s = spark.createDataFrame([(k, y, x) for k, (y, x) in enumerate(zip(labels, scores))], "k long, label int, score double")
    for call in (lambda: metrics.evaluate(s, tie=F.col("k")), lambda: metrics.threshold_metrics(s), lambda: metrics.ranking_metrics(s), lambda: metrics.at_k(s, [1], tie=F.col("k"))):
        with pytest.raises(ValueError):
            call()


def test_bad_thresholds_and_budgets(spark):
    s = scored(spark, [0, 1], [0.1, 0.2])
    for bad in ({"threshold": float("nan")}, {"budgets": [3]}, {"budgets": [0]}, {"fractions": [0.0]}):
        with pytest.raises(ValueError):
            metrics.evaluate(s, tie=F.col("k"), **bad)
