"""Snapshots and windows of graphs in time: one plan for all windows, rows tagged with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import floor_divide
from .ordering import with_row_index


def _check(bin_us: int, stride_us: int) -> None:
    if bin_us <= 0 or stride_us <= 0:
        raise ValueError("bin and stride must be positive")


def bounds(rows: DataFrame, time_col: str = "t_us") -> tuple[int | None, int | None]:
    """(first time, last time + 1) of the rows."""
    low, high = rows.agg(F.min(time_col), F.max(time_col)).first()
    return low, None if high is None else high + 1


def in_windows(rows: DataFrame, *, bin_us: int, stride_us: int, start_us: int, end_us: int, drop_last: bool = True, context_us: int = 0, time_col: str = "t_us") -> DataFrame:
    """A row for each window that holds it: window_start, window_end, is_target added.

    Windows are [s, s + bin) for s = start, start + stride, ...; the last one that would stick out past the
    end is dropped, or clipped there without drop_last, as are all later ones. A window also
    holds rows of the context before its start, which are no targets. Which windows hold a row follows
    from its time by arithmetic, so nothing is joined.
    """
    _check(bin_us, stride_us)
    t, s, e = F.col(time_col), F.lit(start_us), F.lit(end_us)
    last = (end_us - start_us - bin_us) // stride_us if drop_last else (end_us - start_us - 1) // stride_us
    if last < 0:
        return rows.withColumns({"window_start": F.lit(0).cast("long"), "window_end": F.lit(0).cast("long"), "is_target": F.lit(False)}).where(F.lit(False))
    low = F.greatest(F.lit(0), floor_divide(t - s - F.lit(bin_us), stride_us) + 1)
    high = F.least(F.lit(last), floor_divide(t - s + F.lit(context_us), stride_us))
    inside = rows.where((t < e) & (t >= s - F.lit(context_us)))
    k = F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>")))
    out = inside.withColumn("__k", k).withColumn("window_start", s + F.col("__k") * F.lit(stride_us))
    out = out.withColumn("window_end", F.least(F.col("window_start") + F.lit(bin_us), e)).drop("__k")
    return out.where(t < F.col("window_end")).withColumn("is_target", t >= F.col("window_start"))


def numbered(rows: DataFrame, *, name: str = "snapshot_index", targets_only: bool = True) -> DataFrame:
    """rows of windows that have a target, with the windows numbered from 1 in order of time."""
    held = rows.where("is_target") if targets_only else rows
    starts = held.select("window_start").distinct()
    numbers = starts.withColumn(name, F.row_number().over(W.orderBy("window_start")).cast("long"))  # a row for each window
    return rows.join(numbers, "window_start")


def account_snapshots(edges: DataFrame, *, bin_us: int, stride_us: int, start_us: int | None = None, end_us: int | None = None, drop_last: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all snapshots: a transfer for each window that holds it, and the accounts active there."""
    low, high = bounds(edges)
    low, high = low if start_us is None else start_us, high if end_us is None else end_us
    if low is None or high is None:
        low, high = 0, 0
    tagged = numbered(in_windows(edges, bin_us=bin_us, stride_us=stride_us, start_us=low, end_us=high, drop_last=drop_last))
    ends = [tagged.select("snapshot_index", F.col(c).alias("node_id")) for c in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct(), tagged.drop("is_target")


def induced(nodes: DataFrame, edges: DataFrame, keys: list[str], node_id: str = "transaction_id") -> DataFrame:
    """edges in each group of nodes (by keys) that has both ends."""
    both = nodes.select(*keys, node_id)
    first = both.withColumnRenamed(node_id, "source_transaction_id")
    second = both.withColumnRenamed(node_id, "target_transaction_id")
    return edges.join(first, "source_transaction_id").join(second, [*keys, "target_transaction_id"], "left_semi")


def transaction_snapshots(nodes: DataFrame, edges: DataFrame, *, bin_us: int, stride_us: int, context_us: int = 0, start_us: int | None = None, end_us: int | None = None, drop_last: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all snapshots with a target: transfers in the window and its context before, and edges between them."""
    low, high = bounds(nodes)
    low, high = low if start_us is None else start_us, high if end_us is None else end_us
    if low is None or high is None:
        low, high = 0, 0
    tagged = numbered(in_windows(nodes, bin_us=bin_us, stride_us=stride_us, start_us=low, end_us=high, drop_last=drop_last, context_us=context_us))
    return tagged, induced(tagged, edges, ["snapshot_index"])


def static_windows(rows: DataFrame, *, window_us: int, lookback_us: int = 0, drop_last: bool = False, time_col: str = "t_us") -> DataFrame:
    """rows tagged with disjoint windows from the first time on: window_id from 0 over windows with a target, is_target."""
    if lookback_us < 0:
        raise ValueError("lookback must not be negative")
    low, high = bounds(rows, time_col)
    low, high = (0, 0) if low is None else (low, high)
    end = high if drop_last else low + -(-(high - low) // window_us) * window_us if high > low else high
    tagged = in_windows(rows, bin_us=window_us, stride_us=window_us, start_us=low, end_us=end, drop_last=drop_last, context_us=lookback_us, time_col=time_col)
    return numbered(tagged, name="window_id").withColumn("window_id", F.col("window_id") - 1)


def static_edge_windows(edges: DataFrame, *, window_us: int, lookback_us: int = 0, drop_last: bool = False, source: str = "source_index", target: str = "target_index", time_col: str = "t_us") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an account graph's disjoint windows: each window's transfers, and the accounts that they touch under numbers of its own.

    edges: tagged with window_id and is_target, and local_source and local_target, the ends' numbers in the window.
    nodes: window_id, n_id (an account's index in the whole graph), local_index from 0 by n_id. Numbers are positions in
    one order by window and account less the window's first, so that a large window is no single task.
    """
    tagged = static_windows(edges, window_us=window_us, lookback_us=lookback_us, drop_last=drop_last, time_col=time_col)
    ends = [tagged.select("window_id", F.col(c).alias("n_id")) for c in (source, target)]
    placed = with_row_index(ends[0].unionByName(ends[1]).distinct(), [F.col("window_id"), F.col("n_id")], "__at")
    first = placed.groupBy("window_id").agg(F.min("__at").alias("__first"))
    nodes = placed.join(first, "window_id").select("window_id", "n_id", (F.col("__at") - F.col("__first")).alias("local_index"))
    a = nodes.select("window_id", F.col("n_id").alias(source), F.col("local_index").alias("local_source"))
    b = nodes.select("window_id", F.col("n_id").alias(target), F.col("local_index").alias("local_target"))
    return nodes, tagged.join(a, ["window_id", source]).join(b, ["window_id", target])


def context_windows(snapshots: DataFrame, *, context: int, index_col: str = "snapshot_index") -> DataFrame:
    """target_index, position, context_index: the context snapshots right before each target, oldest at position 0.

    snapshots: one row for each; targets without a full context are left out.
    """
    if context < 1:
        raise ValueError("context is one snapshot or more")
    order = snapshots.select(index_col).distinct().withColumn("__n", F.row_number().over(W.orderBy(index_col)))  # a row for each snapshot
    target = order.where(F.col("__n") > context).select(F.col(index_col).alias("target_index"), F.posexplode(F.sequence(F.col("__n") - context, F.col("__n") - 1)).alias("position", "__at"))
    return target.join(order.select(F.col("__n").alias("__at"), F.col(index_col).alias("context_index")), "__at").drop("__at")


def disjoint_offsets(nodes: DataFrame, *, batch_col: str, group_col: str) -> DataFrame:
    """batch, group, num_nodes, node_offset: where each group's nodes begin when a batch's groups are laid one behind another."""
    sizes = nodes.groupBy(batch_col, group_col).agg(F.count(F.lit(1)).alias("num_nodes"))
    w = W.partitionBy(batch_col).orderBy(group_col)
    return sizes.withColumn("node_offset", F.sum("num_nodes").over(w) - F.col("num_nodes"))


def batch_of(position: Column, size: int) -> Column:
    """The mini-batch of a row position."""
    if size < 1:
        raise ValueError("a batch has one row or more")
    return F.floor(position / F.lit(size)).cast("long")
