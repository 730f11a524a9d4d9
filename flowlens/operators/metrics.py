"""Metrics of rare binary risks: at a threshold, over the ranking, and for a budget of alerts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import safe_divide
from .ordering import running_sums


def checked(scored: DataFrame) -> tuple[int, int]:
    """(rows, rows of label 1); labels other than 0 and 1, scores that are not finite and empty tables are errors. One aggregate."""
    score = F.col("score").cast("double")
    good = F.coalesce(F.col("label").cast("double").isin(0.0, 1.0) & ~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))
    total, wrong, positives = scored.agg(F.count(F.lit(1)), F.count_if(~good), F.count_if(F.col("label") == 1)).first()
    if wrong or not total:
        raise ValueError(f"{wrong} of {total} rows lack a label of 0 or 1 or a finite score; at least one row is needed")
    return total, positives


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn; a row is an alert if its score reaches the threshold."""
    alert, bad = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(*(F.count_if(a & b).alias(n) for n, a, b in (("tp", alert, bad), ("fp", alert, ~bad), ("tn", ~alert, ~bad), ("fn", ~alert, bad))))


def rates(counts: DataFrame, prefix: str = "threshold_") -> DataFrame:
    """precision, recall, f1, accuracy, false_positive_rate of additive counts; 0 where nothing is counted. Counts may be summed before."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return counts.select(
        *counts.columns, precision.alias(f"{prefix}precision"), recall.alias(f"{prefix}recall"), safe_divide(2 * precision * recall, precision + recall).alias(f"{prefix}f1"),
        safe_divide(tp + tn, tp + fp + tn + fn).alias(f"{prefix}accuracy"), safe_divide(fp, fp + tn).alias(f"{prefix}false_positive_rate"),
    )


def threshold_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    if not math.isfinite(threshold):
        raise ValueError("a threshold is finite")
    checked(scored)
    return rates(confusion(scored, threshold))


def _by_score(scored: DataFrame) -> DataFrame:
    """score, pos, neg and their running sums from the highest score down. Equal scores are one row, combined before the shuffle."""
    groups = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    return running_sums(groups, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """One row: average_precision (sum of recall steps times precision at distinct scores), roc_auc (ties count half). Both labels must occur."""
    total, positives = checked(scored)
    if not 0 < positives < total:
        raise ValueError("ranking metrics need rows of both labels")
    return _ranking(scored)


def _ranking(scored: DataFrame) -> DataFrame:
    s = _by_score(scored)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))
    sums = s.agg(F.sum(step).alias("ap"), F.sum(area.cast("double")).alias("auc"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(safe_divide(F.col("ap"), F.col("p")).alias("average_precision"), safe_divide(F.col("auc"), F.col("p") * F.col("n")).alias("roc_auc"))


def budget_size(fraction: float | Fraction, n: int) -> int:
    """How many alerts a share of n rows is, rounded up."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction is above 0 and at most 1")
    return math.ceil(fraction * n)


def at_k(scored: DataFrame, budgets: Sequence[int], *, tie: Column) -> DataFrame:
    """k, tp, precision, recall, f1, lift of the k highest scores, equal scores in the order of tie.

    Only the greatest budget of rows is ever gathered (a top-k), and it should be what people can look at.
    """
    if not budgets or any(k < 1 for k in budgets) or len(set(budgets)) != len(budgets):
        raise ValueError("budgets are different positive numbers")
    total, positives = checked(scored)
    if max(budgets) > total:
        raise ValueError("a budget exceeds the number of rows")
    if not positives:
        raise ValueError("budget metrics need a positive row")
    return _top(scored, budgets, tie, total, positives)


def _top(scored: DataFrame, budgets: Sequence[int], tie: Column, total: int, positives: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), tie).limit(max(budgets)).withColumn("__k", F.row_number().over(W.orderBy(F.desc("score"), tie)))
    per = top.withColumn("k", F.explode(F.array(*map(F.lit, budgets)))).where(F.col("__k") <= F.col("k")).groupBy("k").agg(F.sum(F.col("label").cast("long")).alias("tp"))
    precision, recall = F.col("tp") / F.col("k"), F.col("tp") / F.lit(positives)
    return per.select("k", "tp", precision.alias("precision"), recall.alias("recall"), safe_divide(2 * precision * recall, precision + recall).alias("f1"), (precision / F.lit(positives / total)).alias("lift"))


def evaluate(scored: DataFrame, *, tie: Column, threshold: float = 0.5, budgets: Sequence[int] = (), fractions: Sequence[float] = ()) -> DataFrame:
    """Everything in one row: threshold_*, average_precision, roc_auc, and {precision,recall,f1,lift}_at_{k}.

    Both labels must occur; budgets and fractions that come to one k are refused.
    """
    total, positives = checked(scored)
    if not 0 < positives < total:
        raise ValueError("evaluation needs rows of both labels")
    sizes = [*budgets, *(budget_size(f, total) for f in fractions)]
    if len(set(sizes)) != len(sizes):
        raise ValueError("two budgets come to the same k")
    if any(not 1 <= k <= total for k in sizes) or not math.isfinite(threshold):
        raise ValueError("budgets are between 1 and the number of rows, a threshold is finite")
    out = rates(confusion(scored, threshold)).withColumn("__one", F.lit(1)).join(_ranking(scored).withColumn("__one", F.lit(1)), "__one")
    if sizes:
        per = _top(scored, sizes, tie, total, positives)
        wide = per.agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for k in sizes for m in ("precision", "recall", "f1", "lift")))
        out = out.join(wide.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")
