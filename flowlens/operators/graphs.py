"""Account graphs, transaction graphs and event streams, all as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logical_time, strip_string, time_us, timestamp_value
from .ordering import with_previous, with_row_index
from .schema import RESERVED, day_and_clock, find_column, quoted, row_numbered, with_unique_ids


#: Columns that hold an order's columns as they were given.
_BY = "__by_"


@dataclass(frozen=True)
class AccountGraph:
    """nodes: one row per account (node_id and metadata); edges: one row per transfer, parallel ones and loops kept."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class TransactionGraph:
    """nodes: one row per transfer; edges: which transfer can pass on which one's money."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class EventStream:
    """nodes as in an account graph; events: transfers with their place in time order."""

    nodes: DataFrame
    events: DataFrame


def _prepare(df: DataFrame, order_by: Sequence[str] | None, timed: bool, names: dict[str, str | None], numbered: bool = False) -> DataFrame:
    """Rows with both endpoints: transaction_id made unique, source and target stripped, timestamp if timed; RESERVED, the row's position, if numbered."""
    if RESERVED in df.columns:
        raise ValueError(f"column {RESERVED!r} is reserved")
    found = {f: find_column(df.columns, names.get(f), "graph source" if f == "source" else f, missing="none") for f in ("source", "target", "transaction_id")}
    if found["source"] is None or found["target"] is None:
        raise ValueError("a graph needs a source and a target column")
    when = _graph_time(df, names.get("timestamp")) if timed else None
    if timed and when is None:
        raise ValueError("a graph in time needs a timestamp column")
    given = quoted(found["transaction_id"]).cast("string") if found["transaction_id"] else F.lit(None).cast("string")
    made = {f: strip_string(quoted(found[f])) for f in ("source", "target")} | {"transaction_id": given} | ({"timestamp": when} if timed else {})
    if order_by and set(order_by) & set(made):  # rows are in the order of the columns as they are given
        df = df.withColumns({f"{_BY}{k}": quoted(c) for k, c in enumerate(order_by)})
        order_by = [f"{_BY}{k}" for k in range(len(order_by))]
    rows = with_unique_ids(df.withColumns(made), order_by=order_by, numbered=numbered)
    rows = rows.where((F.length("source") > 0) & (F.length("target") > 0))
    return rows.where("timestamp IS NOT NULL") if timed else rows


def _plain(rows: DataFrame) -> DataFrame:
    """rows without what only gave their order."""
    return rows.drop(RESERVED, *(c for c in rows.columns if c.startswith(_BY)))


def _graph_time(df: DataFrame, asked: str | None) -> Column | None:
    """A time from the column asked for or found by its name; text beside a date and a time column is read from these two."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    name = find_column(df.columns, asked, "timestamp", missing="none")
    if name is None:
        return None
    halves = [find_column(df.columns, half, "timestamp", missing="none") for half in ("date", "time")]
    if asked is None and all(halves) and isinstance(kinds[name], T.StringType):
        return day_and_clock(*(quoted(h).cast("string") for h in halves))
    return timestamp_value(quoted(name), kinds[name])


def account_nodes(edges: DataFrame) -> DataFrame:
    """node_id: every endpoint once."""
    return edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()


def with_metadata(nodes: DataFrame, metadata: DataFrame, *, account_id: str | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """nodes with the first metadata row of each account (by order_by); accounts without any get nulls."""
    column = find_column(metadata.columns, account_id, "node_id", missing="none")
    if column is None:
        raise ValueError("metadata needs an account id column")
    rest = [c for c in metadata.columns if c not in (column, "node_id")]
    keyed = row_numbered(metadata, order_by).withColumn("node_id", strip_string(quoted(column))).where(F.length("node_id") > 0)
    # a minimum over a struct is combined before the shuffle, unlike a window's first row
    first = keyed.groupBy("node_id").agg(F.min(F.struct(RESERVED, *map(quoted, rest))).alias("m")).select("node_id", *(F.col("m").getField(c).alias(c) for c in rest))
    return nodes.join(first, "node_id", "left")


def account_graph(df: DataFrame, *, timed: bool = False, metadata: DataFrame | None = None, order_by: Sequence[str] | None = None, metadata_order: Sequence[str] | None = None, account_id: str | None = None, **names: str | None) -> AccountGraph:
    """Accounts as nodes, transfers as edges. Untimed graphs leave time columns as they are; timed ones parse them and drop rows without a time.

    names: explicit column names (source, target, timestamp, transaction_id); one that is absent is an error, not a hint.
    """
    edges = _plain(_prepare(df, order_by, timed, names))
    nodes = account_nodes(edges)
    return AccountGraph(with_metadata(nodes, metadata, account_id=account_id, order_by=metadata_order) if metadata is not None else nodes, edges)


def successor_edges(nodes: DataFrame, delta_us: int, *, id_col: str = "transaction_id", time_col: str = "t_us", bucketed: bool = True) -> DataFrame:
    """Pairs a, b of transfers with a.target = b.source and a.t < b.t <= a.t + delta.

    Columns: source_transaction_id, target_transaction_id, via_account, time_delta_us. bucketed: time is cut
    into buckets of delta, a looks into its own and the next one, so an account's transfers meet only
    those near in time and a busy account spreads over many tasks; each pair still meets once.
    """
    if delta_us < 0:
        raise ValueError("delta must not be negative")
    a = nodes.select(F.col(id_col).alias("source_transaction_id"), F.col("target").alias("via_account"), F.col(time_col).alias("ta"))
    b = nodes.select(F.col(id_col).alias("target_transaction_id"), F.col("source").alias("via_b"), F.col(time_col).alias("tb"))
    near = (F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + F.lit(delta_us))
    same = F.col("via_account") == F.col("via_b")
    if bucketed and delta_us > 0:
        floor = lambda c: F.floor(F.col(c) / F.lit(delta_us)).cast("long")
        a = a.withColumn("ba", F.explode(F.array(floor("ta"), floor("ta") + 1)))
        b = b.withColumn("bb", floor("tb"))
        same = same & (F.col("ba") == F.col("bb"))
    pairs = a.join(b, same & near) if delta_us else a.join(b, same & F.lit(False))
    return pairs.select("source_transaction_id", "target_transaction_id", "via_account", (F.col("tb") - F.col("ta")).alias("time_delta_us"))


def transaction_graph(df: DataFrame, delta: timedelta, *, order_by: Sequence[str] | None = None, **names: str | None) -> TransactionGraph:
    """Transfers as nodes; an edge from each to those that leave its target within delta, delta included, equal times not."""
    if delta < timedelta(0):
        raise ValueError("delta must not be negative")
    nodes = _prepare(df, order_by, True, names).withColumn("t_us", time_us(F.col("timestamp")))
    edges = successor_edges(nodes, delta // timedelta(microseconds=1))
    return TransactionGraph(_plain(nodes), edges)


def graph_sizes(graph: AccountGraph | TransactionGraph | EventStream) -> DataFrame:
    """One row: num_nodes, num_edges (of an event stream num_events), and num_target_nodes where nodes tell targets."""
    links, name = (graph.events, "num_events") if isinstance(graph, EventStream) else (graph.edges, "num_edges")
    targets = [F.count_if("is_target").alias("num_target_nodes")] if "is_target" in graph.nodes.columns else []
    return graph.nodes.agg(F.count(F.lit(1)).alias("num_nodes"), *targets).crossJoin(links.agg(F.count(F.lit(1)).alias(name)))  # a row each


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids that edges name and nodes lack."""
    ends = [edges.select(F.col(c).alias("transaction_id")) for c in ("source_transaction_id", "target_transaction_id")]
    return ends[0].unionByName(ends[1]).join(nodes.select("transaction_id"), "transaction_id", "left_anti").distinct()


def precomputed_graph(nodes: DataFrame, edges: DataFrame, *, node_id: str, edge_source: str, edge_target: str, time: str | None = None, step_size: timedelta | None = None, origin=None, validate: bool = True) -> TransactionGraph:
    """A transaction graph from a given edge list; ordinal times become logical ones by step_size. validate runs the checks of ids and ends."""
    from datetime import datetime, timezone

    for column, frame, what in ((node_id, nodes, "nodes"), (edge_source, edges, "edges"), (edge_target, edges, "edges"), *(((time, nodes, "nodes"),) if time else ())):
        if column not in frame.columns:
            raise ValueError(f"{what} lack the column {column!r}")
    out = nodes.withColumn("transaction_id", strip_string(quoted(node_id)))
    if time:
        kind = nodes.schema[time].dataType
        if isinstance(kind, T.NumericType):
            if step_size is None:
                raise ValueError("ordinal times need a step_size")
            out = out.withColumn("timestamp", logical_time(quoted(time), step_size, origin or datetime(1970, 1, 1, tzinfo=timezone.utc)))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = out.withColumn("timestamp", timestamp_value(quoted(time), kind))
        else:
            raise TypeError("times are dates, timestamps or numbers of steps")
    linked = edges.withColumns({"source_transaction_id": strip_string(quoted(edge_source)), "target_transaction_id": strip_string(quoted(edge_target)), "edge_relation": F.lit("precomputed")})
    if validate:
        if not out.where("transaction_id IS NULL OR transaction_id = ''").isEmpty():
            raise ValueError("transaction ids must not be empty")
        if not out.groupBy("transaction_id").count().where("count > 1").isEmpty():
            raise ValueError("transaction ids must be unique")
        if not unknown_endpoints(out, linked).isEmpty():
            raise ValueError("edges name transactions that nodes lack")
    return TransactionGraph(out, linked)


def event_stream(df: DataFrame, *, order_by: Sequence[str] | None = None, **names: str | None) -> EventStream:
    """Transfers with seq, their place by time, equal times by their order in the input (order_by, where it is given)."""
    # without a given order, or with ids to repair, rows have a number; else the order's own columns do
    rows = _prepare(df, order_by, True, names, numbered=not order_by).withColumn("t_us", time_us(F.col("timestamp")))
    ties = [RESERVED] if RESERVED in rows.columns else [c for c in rows.columns if c.startswith(_BY)] or list(order_by)
    return EventStream(account_nodes(rows), _plain(with_row_index(rows, [F.col("t_us"), *map(quoted, ties)], "seq")))


def out_of_order(events: DataFrame, time_col: str = "t_us", order_col: str = "seq", strict: bool = False) -> DataFrame:
    """Rows whose time is before (strict: not after) that of the row ahead of them in order_col."""
    rows = with_previous(events, [F.col(order_col)], {"__last": time_col})
    wrong = F.col(time_col) <= F.col("__last") if strict else F.col(time_col) < F.col("__last")
    return rows.where(wrong).drop("__last")
