"""Tables for tensor libraries: contiguous indexes, edge lists by index, numeric features, labels, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import account_nodes
from .ordering import with_row_index
from .schema import quoted


def feature_column(df: DataFrame, name: str) -> Column:
    """A feature as float: numbers and booleans cast, intervals in seconds; anything else is a TypeError."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DayTimeIntervalType):
        return (quoted(name).cast("interval day to second").cast("decimal(38,6)")).cast("float")
    if isinstance(kind, T.BooleanType):
        return quoted(name).cast("int").cast("float")
    if isinstance(kind, T.NumericType):
        return quoted(name).cast("float")
    raise TypeError(f"{name} is no number, boolean or interval")


def features(df: DataFrame, columns: Sequence[str]) -> Column:
    """array<float> of the columns; empty for none."""
    return F.array(*(feature_column(df, c) for c in columns)).cast("array<float>")


def label_column(df: DataFrame, name: str) -> Column:
    if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        raise TypeError(f"{name} is no number or boolean")
    return quoted(name)


def time_ns(time_us: Column) -> Column:
    return time_us * F.lit(1000)


def duration(us: Column) -> Column:
    """Microseconds as an interval of days to seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def node_index(nodes: DataFrame, order_by: Sequence[Column], id_col: str = "node_id", name: str = "node_index") -> DataFrame:
    """nodes with a contiguous index from 0 in the order of order_by."""
    return with_row_index(nodes, list(order_by), name)


def account_dictionary(edges: DataFrame, name: str = "code") -> DataFrame:
    """node_id, code: every endpoint once, codes from 0 in the order of the ids."""
    return node_index(account_nodes(edges), [F.col("node_id")], name=name)


def encode_edges(edges: DataFrame, index: DataFrame, *, source: str, target: str, id_col: str, name: str, validate: bool = False) -> DataFrame:
    """edges with source_index and target_index; validate: an endpoint that index lacks is an error instead of a lost edge."""
    a = index.select(F.col(id_col).alias(source), F.col(name).alias("source_index"))
    b = index.select(F.col(id_col).alias(target), F.col(name).alias("target_index"))
    if validate:
        out = edges.join(a, source, "left").join(b, target, "left")
        if not out.where("source_index IS NULL OR target_index IS NULL").isEmpty():
            raise ValueError("an edge's endpoint has no index")
        return out
    return edges.join(a, source).join(b, target)


def edge_times(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Transaction-graph edges with edge_us, the time of the transfer they lead to."""
    return edges.join(nodes.select(F.col("transaction_id").alias("target_transaction_id"), F.col("t_us").alias("edge_us")), "target_transaction_id")


def temporal_table(events: DataFrame, dictionary: DataFrame, *, message: Sequence[str] = (), label: str | None = None, code: str = "code") -> DataFrame:
    """src, dst, t (ns), msg (array of float), y if there is a label, seq: one row per event."""
    coded = encode_edges(events, dictionary, source="source", target="target", id_col="node_id", name=code)
    cols = [F.col("source_index").alias("src"), F.col("target_index").alias("dst"), time_ns(F.col("t_us")).alias("t"), features(events, message).alias("msg")]
    return coded.select(*cols, *([label_column(events, label).alias("y")] if label else []), "seq")
