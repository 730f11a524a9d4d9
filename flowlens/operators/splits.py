"""Splits by time that leak nothing from later to earlier parts."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import bounds, transaction_snapshots


def split_of(time: Column, train_end: int, validation_end: int) -> Column:
    """train before train_end, validation before validation_end, test from there on."""
    if train_end >= validation_end:
        raise ValueError("train_end must be before validation_end")
    return F.when(time < train_end, "train").when(time < validation_end, "validation").otherwise("test")


def induced_split(nodes: DataFrame, edges: DataFrame, *, train_end: int, validation_end: int, time_col: str = "t_us") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a column split; edges between parts are gone."""
    parts = nodes.withColumn("split", split_of(F.col(time_col), train_end, validation_end))
    a = parts.select(F.col("transaction_id").alias("source_transaction_id"), "split")
    b = parts.select(F.col("transaction_id").alias("target_transaction_id"), "split")
    return parts, edges.join(a, "source_transaction_id").join(b, ["target_transaction_id", "split"], "left_semi")


def split_snapshots(nodes: DataFrame, edges: DataFrame, part: str, *, train_end: int, validation_end: int, test_end: int | None = None, bin_us: int, stride_us: int, context_us: int = 0, drop_last: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the snapshots of one part: train, validation or test, the targets of which lie in that part.

    Training snapshots know nothing but the training part's own graph; those of the later parts take the context
    before their windows from the whole graph, as it is known by then.
    """
    spans = {"train": (None, train_end), "validation": (train_end, validation_end), "test": (validation_end, test_end)}
    if part not in spans:
        raise ValueError(f"a part is one of {sorted(spans)}")
    if train_end >= validation_end or (test_end is not None and test_end <= validation_end):
        raise ValueError("train_end, validation_end and test_end rise")
    if part == "train":
        nodes, edges = (x.where(F.col("split") == part).drop("split") for x in induced_split(nodes, edges, train_end=train_end, validation_end=validation_end))
    start, end = spans[part]
    return transaction_snapshots(nodes, edges, bin_us=bin_us, stride_us=stride_us, context_us=context_us, start_us=start, end_us=end, drop_last=drop_last)


def node_masks(nodes: DataFrame, *, train_end: int, validation_end: int, time_col: str = "t_us") -> DataFrame:
    """nodes with train_mask, validation_mask, test_mask, of which each row has one; the graph stays whole."""
    part = split_of(F.col(time_col), train_end, validation_end)
    return nodes.withColumns({f"{p}_mask": part == p for p in ("train", "validation", "test")})


def fraction_cutoffs(nodes: DataFrame, *, train: Fraction = Fraction(3, 5), validation: Fraction = Fraction(4, 5), time_col: str = "t_us") -> tuple[int, int]:
    """Cutoffs at shares of the span of time."""
    low, end = bounds(nodes, time_col)
    if low is None:
        raise ValueError("no rows to split")
    span = end - 1 - low
    return low + int(span * train), low + int(span * validation)


def count_split(events: DataFrame, *, train: Fraction = Fraction(3, 5), validation: Fraction = Fraction(4, 5), order_col: str = "seq", time_col: str = "t_us") -> DataFrame:
    """events with split: parts by share of their number, each boundary moved past the events that share its time.

    seq must count the events in time order from 0. The boundary's time is looked up, so that no window spans all events.
    """
    n = events.count()
    cuts = []
    for share in (train, validation):
        at = int(n * share)
        row = events.where(F.col(order_col).isin([at - 1, at])).select(order_col, time_col).collect()
        times = {r[0]: r[1] for r in row}
        if at in times and times.get(at - 1) == times[at]:
            at = events.where(F.col(time_col) <= times[at]).count()
        cuts.append(at)
    if not 0 < cuts[0] < cuts[1] < n:
        raise ValueError("the events do not make three parts with times of their own")
    return events.withColumn("split", split_of(F.col(order_col), cuts[0], cuts[1]))


def time_bands(rows: DataFrame, *, bands: int, limit: int, order_by: list[Column], keep_last: bool = True, time_col: str = "t_us") -> DataFrame:
    """A sample spread over time: of each of bands equal parts of the span the first limit // bands rows by order_by.

    keep_last: the last band holds the rows at the last time; without it they are left out.
    """
    from pyspark.sql import Window as W

    low, end = bounds(rows, time_col)
    if low is None:
        return rows.withColumn("band", F.lit(0)).where(F.lit(False))
    span = end - 1 - low
    # whole division, as a quotient would be rounded before its floor; in decimals, as the product may not fit a long
    band = F.call_function("div", (F.col(time_col) - low).cast("decimal(38,0)") * bands, F.lit(max(1, span)).cast("decimal(38,0)")).cast("int")
    dealt = rows.withColumn("band", F.least(band, F.lit(bands - 1)) if keep_last else band)
    if not keep_last and span:
        dealt = dealt.where(F.col(time_col) < low + span)
    return dealt.withColumn("__k", F.row_number().over(W.partitionBy("band").orderBy(*order_by))).where(F.col("__k") <= max(1, limit // bands)).drop("__k")
