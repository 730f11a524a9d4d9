"""Queries of what the others do not reach: histories, repeated ids, parts' snapshots, windows of edges, dispatch, guards, streams."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clamp, logical_time, register_functions, time_us, timestamp_value
from ..operators import features as gf
from ..operators import graphs, metrics, sampling, schema, splits, tensors, windows
from . import spec
from .queries import _error_ids, _events, event_source, event_transfers, feature_rows, item_transfers, query, rounded, scored
from .sql import _CUTS, BINS, DAY, EVENTS, HOUR, US_4H, _at_k, _score, event_hops, histogram, snapshots, successors, with_
from .stream_run import drain

# ---- graph features over time ----

HISTORY = gf.FeatureConfig(fan_in=gf.Pattern(DAY, BINS), degree_out=gf.Pattern(DAY, BINS))
REINSERT = gf.FeatureConfig(degree_out=gf.Pattern(12 * HOUR, BINS))


def _thirds(rows: DataFrame) -> tuple[int, int]:
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    return low + (high - low) // 3, low + 2 * (high - low) // 3


def _from_zero(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.col("seq") - F.lit(rows.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]))


@query
def gfp_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the last third of time in batches, the rest inserted before."""
    rows = feature_rows(spark, sf_dir)
    _, cut = _thirds(rows)
    fitted = gf.FittedFeatures(HISTORY).fit(rows.where(F.col("t") < cut))
    return fitted.transform(_from_zero(rows.where(F.col("t") >= cut)), batch_size=512).select("edge_id", *HISTORY.columns())


@query
def gfp_partial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the history inserted in two parts, under parameters set before."""
    rows = feature_rows(spark, sf_dir)
    a, b = _thirds(rows)
    fitted = gf.FittedFeatures(REINSERT).fit(rows).with_config(fan_in=HISTORY.fan_in, degree_out=HISTORY.degree_out)
    fitted = fitted.partial_fit(rows.where(F.col("t") < a)).partial_fit(_from_zero(rows.where((F.col("t") >= a) & (F.col("t") < b))))
    return fitted.transform(_from_zero(rows.where(F.col("t") >= b)), batch_size=512).select("edge_id", *HISTORY.columns())


@query
def gfp_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row carries one of five ids, which enter again once their last edge has left."""
    rows = feature_rows(spark, sf_dir)
    again = F.concat(F.lit("x"), (F.floor(F.col("seq") / 10) % 5).cast("string"))
    rows = rows.withColumn("edge_id", F.when(F.col("seq") % 10 == 0, again).otherwise(F.col("edge_id")))
    return gf.graph_features(REINSERT, rows, batch_size=512).select("seq", *REINSERT.columns())


_BY_THIRDS = [
    EVENTS, "cut AS (SELECT min(t_us) + 2 * (max(t_us) - min(t_us)) // 3 AS z FROM ev)", "nh AS (SELECT min(seq) AS n FROM ev, cut WHERE t_us >= z)",
    "r AS (SELECT transaction_id AS eid, source AS u, target AS v, t_us AS t, seq, CASE WHEN t_us < z THEN -1 ELSE (seq - n) // 512 END AS b FROM ev, cut, nh)", "ends AS (SELECT b, max(t) AS latest FROM r WHERE b >= 0 GROUP BY b)",
    f"vis AS (SELECT ends.b, ends.latest, r.eid, r.u, r.v, r.t, r.seq, r.b AS eb FROM ends JOIN r ON r.b <= ends.b AND r.t > ends.latest - {DAY})",
]
_HISTORY = f"SELECT CAST(seq AS VARCHAR) AS edge_id, * EXCLUDE (seq) FROM ({histogram('fan_in', DAY, rows=_BY_THIRDS)}) JOIN ({histogram('degree_out', DAY, rows=_BY_THIRDS)}) USING (seq)"
_AGAIN = [
    EVENTS,
    "a0 AS (SELECT CASE WHEN seq % 10 = 0 THEN 'x' || (seq // 10 % 5) ELSE transaction_id END AS eid, source AS u, target AS v, t_us AS t, seq, seq // 512 AS b, lag(t_us) OVER (ORDER BY seq) AS lb FROM ev)",
    # the row ahead of a repeated id is of an id of its own, so it has entered
    "first AS (SELECT eid, min(seq) AS seq, arg_min(t, seq) AS t FROM a0 WHERE seq % 10 = 0 GROUP BY eid)",
    f"""chain AS (SELECT eid, seq, t FROM first UNION ALL
  SELECT c.eid, min(n.seq), arg_min(n.t, n.seq) FROM chain c JOIN a0 n ON n.eid = c.eid AND n.seq > c.seq AND n.seq % 10 = 0 AND n.lb >= c.t + {12 * HOUR} GROUP BY c.eid, c.seq, c.t)""",
    "r AS (SELECT a0.*, a0.seq % 10 <> 0 OR chain.seq IS NOT NULL AS entered FROM a0 LEFT JOIN chain USING (seq))".replace("a0.*", "a0.eid, u, v, a0.t, a0.seq, b"),
    "ends AS (SELECT b, max(t) AS latest FROM r WHERE entered GROUP BY b)",
    f"vis AS (SELECT ends.b, ends.latest, r.eid, r.u, r.v, r.t, r.seq, r.b AS eb FROM ends JOIN r ON entered AND r.b <= ends.b AND r.t > ends.latest - {12 * HOUR})",
]


@query
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a configuration on a table without rows."""
    config = gf.FeatureConfig(fan_in=gf.Pattern(DAY, (2, 3)), statistics_window=DAY, statistics=("mean", "fan"), value_columns=("amount",))
    out = gf.graph_features(config, feature_rows(spark, sf_dir).where(F.lit(False)))
    return spark.createDataFrame([(k, c, out.count()) for k, c in enumerate(out.columns)], "position int, name string, n long")


# ---- parts of time ----


def _split_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    edges = graphs.successor_edges(t, US_4H)
    train_end, validation_end = splits.fraction_cutoffs(t)
    for part in ("train", "validation", "test"):
        n, e = splits.split_snapshots(t, edges, part, train_end=train_end, validation_end=validation_end, bin_us=DAY, stride_us=DAY, context_us=US_4H, drop_last=False)
        yield part, n, e


@query
def split_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [n.select(F.lit(part).alias("part"), "snapshot_index", "transaction_id", "is_target") for part, n, _ in _split_snapshots(spark, sf_dir)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def split_snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [e.select(F.lit(part).alias("part"), "snapshot_index", "source_transaction_id", "target_transaction_id") for part, _, e in _split_snapshots(spark, sf_dir)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _part_sql(part: str, select: str) -> str:
    span = {"train": "t_us < a", "validation": "t_us >= a AND t_us < z", "test": "t_us >= z"}[part]
    low = {"train": "(SELECT min(t_us) FROM ev)", "validation": "a", "test": "z"}[part]
    high = {"train": "a", "validation": "z", "test": "(SELECT max(t_us) + 1 FROM ev)"}[part]
    seen = f"(SELECT * FROM ev, ct WHERE {span})" if part == "train" else "ev"
    return with_(
        EVENTS, _CUTS, successors("e", "ev", US_4H), f"bd AS (SELECT {low} AS lo, {high} AS hi FROM ct)",
        f"w AS (SELECT s AS window_start, least(s + {DAY}, hi) AS window_end FROM (SELECT unnest(range(lo, hi, {DAY})) AS s, hi FROM bd))",
        f"tagged AS (SELECT x.transaction_id, w.window_start, x.t_us >= w.window_start AS is_target FROM {seen} x JOIN w ON x.t_us >= w.window_start - {US_4H} AND x.t_us < w.window_end)",
        "num AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS snapshot_index FROM (SELECT DISTINCT window_start FROM tagged WHERE is_target))", "snap AS (SELECT * FROM tagged JOIN num USING (window_start))",
    ) + select.format(part)


def _parts_sql(select: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_part_sql(p, select)})" for p in ("train", "validation", "test"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return tensors.encode_edges(t, tensors.account_dictionary(t), source="source", target="target", id_col="node_id", name="code")


@query
def static_edge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = windows.static_edge_windows(_indexed(spark, sf_dir), window_us=5 * DAY, lookback_us=DAY)
    return edges.select("window_id", F.col("seq").alias("e_id"), "is_target", "source_index", "target_index", "local_source", "local_target")


@query
def static_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.static_windows(event_transfers(spark, sf_dir), window_us=5 * DAY, lookback_us=DAY)
    return out.select("window_id", "transaction_id", "is_target")


_DICT = "dc AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM (SELECT source AS node_id FROM ev UNION SELECT target FROM ev))"
_STATIC = f"""lo AS (SELECT min(t_us) AS lo FROM ev),
tg AS (SELECT (t_us - lo) // {5 * DAY} AS w, true AS is_target, ev.* FROM ev, lo UNION ALL SELECT (t_us - lo) // {5 * DAY} + 1, false, ev.* FROM ev, lo WHERE (t_us - lo) % {5 * DAY} >= {4 * DAY}),
nm AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS window_id FROM (SELECT DISTINCT w FROM tg WHERE is_target)), st AS (SELECT * FROM tg JOIN nm USING (w))"""


# ---- sampling ----


@query
def causal_edge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = sampling.causal_edges(e, _error_ids(e, "event_id"), fanout=[3], label="label", message=["amount"])
    return out.select("target_id", "hop", "account", "event_id", "event_us", "target_time", "target_label", F.round(F.col("target_message")[0], 6).alias("amount"), "target_source", "target_target")


@query
def causal_edges_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return sampling.causal_events_in_windows(e, _error_ids(e, "event_id"), window_us=2 * DAY, lookback_us=12 * HOUR, fanout=[3])


@query
def event_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of errors as a score, of the second half of time; the first half only enters the state."""
    t = event_transfers(spark, sf_dir)
    low, high = t.agg(F.min("t_us"), F.max("t_us")).first()
    cut = low + (high - low) // 2
    out = sampling.score_before_update(t.where(F.col("t_us") < cut), t.where(F.col("t_us") >= cut))
    return rounded(out.select("transaction_id", "target_event_mask", "score"), "score")


# ---- dispatch and tables ----


def _spec(kind: str) -> spec.GraphSpec:
    return {
        "account": spec.GraphSpec("account", "static"), "events": spec.GraphSpec("account", "event_stream"), "transaction": spec.GraphSpec("transaction", "static", edge_delta=timedelta(hours=4)),
        "snapshot": spec.GraphSpec("account", "snapshot", bin_size=timedelta(days=1), stride=timedelta(days=1)),
    }[kind]


@query
def graph_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes and links each kind of graph of the same transfers has."""
    out = None
    for kind in ("account", "events", "transaction", "snapshot"):
        sizes = graphs.graph_sizes(spec.prepare_graph(event_transfers(spark, sf_dir), _spec(kind), order_by=["seq"]))
        row = sizes.toDF("num_nodes", "num_links").select(F.lit(kind).alias("kind"), "num_nodes", "num_links")
        out = row if out is None else out.unionByName(row)
    return out


@query
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, targets and edges of all transaction snapshots together."""
    t = event_transfers(spark, sf_dir)
    n, e = windows.transaction_snapshots(t, graphs.successor_edges(t, US_4H), bin_us=2 * DAY, stride_us=2 * DAY, context_us=US_4H)
    return graphs.graph_sizes(graphs.TransactionGraph(n, e))


def _tables(spark: SparkSession, sf_dir: str, kind: str, **options) -> dict[str, DataFrame]:
    return spec.tensor_tables(spec.prepare_graph(event_transfers(spark, sf_dir), _spec(kind), order_by=["seq"]), spec.TensorSpec(**options))


@query
def account_index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir, "account", edge_features=("amount",), label="label")["edges"]
    return e.select("transaction_id", "source_index", "target_index", F.round(F.col("edge_attr")[0].cast("double"), 3).alias("amount"), "edge_time", "y")


@query
def account_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _tables(spark, sf_dir, "account")["nodes"]
    return n.select("node_id", "node_index", F.size("x").alias("width"))


@query
def transaction_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _tables(spark, sf_dir, "transaction", node_features=("amount",), label="label")["nodes"]
    return n.select("transaction_id", "node_index", F.round(F.col("x")[0].cast("double"), 3).alias("amount"), "node_time", "y")


@query
def transaction_edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir, "transaction", edge_features=("time_delta_us",))["edges"]
    return e.select("source_index", "target_index", "edge_time")


@query
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir, "events", edge_features=("amount",), label="label")["events"]
    return e.select("seq", "src", "dst", "t", F.round(F.col("msg")[0].cast("double"), 3).alias("amount"), "y")


@query
def sorted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.account_dictionary(event_transfers(spark, sf_dir), "position")


# ---- tables and columns ----


@query
def relaxed_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items under each other: a whole number, a decimal and a text column meet others of their names."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_custkey").cast("int").alias("v"), F.col("o_orderstatus").alias("s"))
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_quantity").cast("double").alias("v"), F.col("l_linenumber").cast("int").alias("s"), F.col("l_returnflag").alias("only"))
    return rounded(schema.concat_relaxed([o, i]).groupBy("k", "s", "only").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")), "v")


@query
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir).withColumn("amount", F.when(F.col("seq") % 7 != 0, F.col("amount"))).withColumn("label", F.when(F.col("seq") % 5 == 0, F.lit(2)).otherwise(F.col("label")))
    return schema.usable_rows(t, ["amount", "source"], label="label", limit=1_000, order_by=[F.col("t_us"), F.col("seq")]).select("transaction_id", "label")


@query
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as times, lenient casts, durations and their seconds, bounds and ceilings."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = o.withColumn("day", F.col("o_orderdate").cast("date")).withColumn("odd", F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string")))
    day = day.withColumn("gap", tensors.duration(F.col("o_orderkey").cast("long") * 1_500_000))
    return day.select(
        "o_orderkey", time_us(timestamp_value(F.col("day"), T.DateType())).alias("day_us"), F.col("odd").try_cast("long").alias("number"), tensors.feature_column(day, "gap").cast("double").alias("gap_s"),
        F.round(clamp(F.col("o_totalprice"), 1_000, 200_000), 4).alias("held"), F.ceil(F.col("o_orderkey") / 1_000).cast("long").alias("thousands"),
    )


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column functions by their names in SQL."""
    register_functions(spark)
    event_transfers(spark, sf_dir).createOrReplaceTempView("flow_transfers")
    return spark.sql("SELECT seq, round(flow_sigmoid(amount - 10), 6) AS risk, round(flow_safe_divide(amount, label), 6) AS per, flow_strip(concat(' ', source, '\\t')) AS source, flow_bucket(CAST(amount AS BIGINT), array(2, 5, 20)) AS bucket FROM flow_transfers")


# ---- metrics ----


@query
def budget_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    n = s.count()
    out = metrics.evaluate(s, tie=F.col("seq"), threshold=0.98, fractions=[0.01, 0.1])
    a, b = (metrics.budget_size(f, n) for f in (0.01, 0.1))
    names = {f"{m}_at_{k}": f"{m}_{x}" for k, x in ((a, "low"), (b, "high")) for m in ("precision", "recall", "f1", "lift")}
    return rounded(out.select(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), *(F.col(c).alias(x) for c, x in names.items())), *names.values())


@query
def mergeable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every day, added up, give the rates of all."""
    t = event_transfers(spark, sf_dir).select((F.col("amount") / (F.col("amount") + 1)).alias("score"), "label", F.floor(F.col("t_us") / DAY).alias("day"))
    days = [r[0] for r in t.select(F.col("day") % 4).distinct().collect()]
    parts = None
    for d in days:
        c = metrics.confusion(t.where(F.col("day") % 4 == d), 0.98)
        parts = c if parts is None else parts.unionByName(c)
    out = metrics.rates(parts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn"))))
    return rounded(out, *[c for c in out.columns if c.startswith("threshold_")])


@query
def guard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which error each wrong call raises."""
    t, r = event_transfers(spark, sf_dir), feature_rows(spark, sf_dir)
    s = scored(spark, sf_dir)
    nodes, edges = t, graphs.successor_edges(t, US_4H)
    calls = {
        "pattern window": lambda: gf.Pattern(-1), "pattern bins": lambda: gf.Pattern(1, (3, 2)), "feature name": lambda: gf.FittedFeatures(HISTORY).with_config(no_such=1), "retention": lambda: gf.FeatureConfig(retention=-2),
        "statistic": lambda: gf.FeatureConfig(statistics=("odd",), statistics_window=1), "cycle length": lambda: gf.FeatureConfig(length_cycle=gf.Pattern(1, (2,))), "null time": lambda: gf.graph_features(HISTORY, r.withColumn("t", F.lit(None).cast("long"))),
        "equal times": lambda: gf.causal_features(HISTORY, r.withColumn("t", F.lit(1).cast("long"))), "fanout": lambda: sampling.causal_nodes(nodes, edges, t, fanout=[0]), "strategy": lambda: sampling.causal_nodes(nodes, edges, t, fanout=[1], strategy="first"),
        "recent size": lambda: sampling.recent_neighbors(t, size=0), "cutoffs": lambda: splits.node_masks(t, train_end=5, validation_end=5), "test end": lambda: splits.split_snapshots(nodes, edges, "test", train_end=1, validation_end=3, test_end=2, bin_us=1, stride_us=1),
        "bin": lambda: windows.account_snapshots(t, bin_us=0, stride_us=1), "delta": lambda: graphs.transaction_graph(t, timedelta(seconds=-1)), "clock": lambda: logical_time(F.col("seq"), timedelta(0), datetime(2020, 1, 1, tzinfo=timezone.utc)),
        "no zone": lambda: logical_time(F.col("seq"), timedelta(1), datetime(2020, 1, 1)), "spec": lambda: spec.GraphSpec("transaction", "snapshot", edge_delta=timedelta(1)), "spec needs": lambda: spec.GraphSpec("account", "snapshot"),
        "text feature": lambda: tensors.features(t, ["source"]), "budget": lambda: metrics.at_k(s, [0], tie=F.col("seq")), "fraction": lambda: metrics.budget_size(1.5, 10), "labels": lambda: metrics.evaluate(s.withColumn("label", F.lit(2)), tie=F.col("seq")),
        "score": lambda: metrics.ranking_metrics(s.withColumn("score", F.lit(float("nan")))), "one label": lambda: metrics.ranking_metrics(s.withColumn("label", F.lit(1))), "same budget": lambda: metrics.evaluate(s, tie=F.col("seq"), budgets=[5, 5]),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "none"))
        except (ValueError, TypeError, KeyError, NotImplementedError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, error string")


_KINDS = {"feature name": "KeyError", "spec": "NotImplementedError", "text feature": "TypeError"}
_GUARDS = (
    "pattern window", "pattern bins", "feature name", "retention", "statistic", "cycle length", "null time", "equal times", "fanout", "strategy", "recent size", "cutoffs", "test end", "bin", "delta", "clock", "no zone", "spec", "spec needs",
    "text feature", "budget", "fraction", "labels", "score", "one label", "same budget",
)


# ---- streams ----


@query
def streaming_sliding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import windowed_flows

    flows = drain(windowed_flows(event_source(spark, sf_dir), window="2 days", slide="1 day"), ["window_start", "window_end", "account"])
    return rounded(flows.select(time_us(F.col("window_start")).alias("window_us"), "account", "n_out", "n_in", "amount_out", "amount_in"), "amount_out", "amount_in")


@query
def stream_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account has sent within a day, kept as state of a stream."""
    from ..streaming import rolling_account_state

    out = drain(rolling_account_state(event_source(spark, sf_dir), retention_us=DAY))
    return rounded(out, "amount_out")


_ROLLING = f"""SELECT a.transaction_id, a.source, a.t_us, count(DISTINCT b.target) AS fan_out, count(*) AS degree_out, round(sum(b.amount), 6) AS amount_out
FROM ev a JOIN ev b ON a.source = b.source AND b.t_us > a.t_us - {DAY} AND (b.t_us < a.t_us OR (b.t_us = a.t_us AND b.transaction_id <= a.transaction_id)) GROUP BY ALL"""
_TX_INDEX = "tx AS (SELECT *, row_number() OVER (ORDER BY t_us, transaction_id) - 1 AS k FROM ev)"

SQL = {
    "gfp_history": _HISTORY,
    "gfp_partial_fit": _HISTORY,
    "gfp_reinsert": histogram("degree_out", 12 * HOUR, rows=_AGAIN).replace("WITH ", "WITH RECURSIVE ", 1),
    "feature_columns": "SELECT row_number() OVER () - 1 AS position, name, 0 AS n FROM (SELECT unnest(['edge_id', 'source', 'target', 't', 'seq', 'amount', 'fan_in_0', 'fan_in_1'] || list_concat(['source_out_fan', 'source_out_mean_amount', 'source_in_fan', 'source_in_mean_amount'], ['target_out_fan', 'target_out_mean_amount', 'target_in_fan', 'target_in_mean_amount'])) AS name)",
    "split_snapshot_nodes": _parts_sql("SELECT '{0}' AS part, snapshot_index, transaction_id, is_target FROM snap"),
    "split_snapshot_edges": _parts_sql("SELECT '{0}' AS part, a.snapshot_index, source_transaction_id, target_transaction_id FROM e JOIN snap a ON a.transaction_id = source_transaction_id JOIN snap b ON b.transaction_id = target_transaction_id AND a.snapshot_index = b.snapshot_index"),
    "static_edge_windows": with_(EVENTS, _DICT, _STATIC, "en AS (SELECT window_id, k, row_number() OVER (PARTITION BY window_id ORDER BY k) - 1 AS li FROM (SELECT window_id, k FROM st JOIN dc ON node_id = source UNION SELECT window_id, k FROM st JOIN dc ON node_id = target))")
    + "SELECT st.window_id, seq AS e_id, is_target, a.k AS source_index, b.k AS target_index, x.li AS local_source, y.li AS local_target FROM st JOIN dc a ON a.node_id = source JOIN dc b ON b.node_id = target JOIN en x ON x.window_id = st.window_id AND x.k = a.k JOIN en y ON y.window_id = st.window_id AND y.k = b.k",
    "static_window_rows": with_(EVENTS, _STATIC) + "SELECT window_id, transaction_id, is_target FROM st",
    "causal_edge_context": with_(EVENTS, event_hops(3)) + "SELECT target_id, 1 AS hop, account, event_id, event_us, target_us AS target_time, label AS target_label, round(amount, 6) AS amount, source AS target_source, target AS target_target FROM h1 JOIN ev ON ev.seq = target_id",
    "causal_edges_windowed": with_(
        EVENTS, "b AS (SELECT min(t_us) AS lo FROM ev)", f"fr AS (SELECT (t_us - lo) // {2 * DAY} AS window_id, lo + (t_us - lo) // {2 * DAY} * {2 * DAY} - {12 * HOUR} AS floor, seq AS target_id, t_us AS target_us, unnest(list_distinct([source, target])) AS account FROM ev, b WHERE label = 1)",
    ) + "SELECT window_id, target_id, 1 AS hop, account, x.seq AS event_id, x.t_us AS event_us FROM fr JOIN ev x ON x.target = account AND x.t_us < target_us AND x.t_us >= floor QUALIFY row_number() OVER (PARTITION BY target_id, account ORDER BY x.t_us DESC, x.seq DESC) <= 3",
    "event_predictor": with_(EVENTS, "cut AS (SELECT min(t_us) + (max(t_us) - min(t_us)) // 2 AS z FROM ev)", "m AS (SELECT source, t_us, count(*) AS n, sum(label) AS bad FROM ev GROUP BY ALL)", "st AS (SELECT source, t_us, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(bad) OVER w, 0) AS bad FROM m WINDOW w AS (PARTITION BY source ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    + "SELECT transaction_id, t_us >= z AS target_event_mask, CASE WHEN t_us >= z THEN round((st.bad + 1) / (st.n + 2), 6) END AS score FROM ev JOIN st USING (source, t_us), cut",
    "graph_dispatch": with_(EVENTS, successors("e", "ev", US_4H), *snapshots("ev", DAY, DAY, True), "nd AS (SELECT source AS a FROM ev UNION SELECT target FROM ev)", "sn AS (SELECT snapshot_index, source AS a FROM snap UNION SELECT snapshot_index, target FROM snap)")
    + "SELECT 'account' AS kind, (SELECT count(*) FROM nd) AS num_nodes, (SELECT count(*) FROM ev) AS num_links UNION ALL SELECT 'events', (SELECT count(*) FROM nd), (SELECT count(*) FROM ev) UNION ALL SELECT 'transaction', (SELECT count(*) FROM ev), (SELECT count(*) FROM e) UNION ALL SELECT 'snapshot', (SELECT count(*) FROM sn), (SELECT count(*) FROM snap)",
    "graph_sizes": with_(EVENTS, successors("e", "ev", US_4H), *snapshots("ev", 2 * DAY, 2 * DAY, True, US_4H)) + "SELECT (SELECT count(*) FROM snap) AS num_nodes, (SELECT count(*) FROM snap WHERE is_target) AS num_target_nodes, (SELECT count(*) FROM e JOIN snap a ON a.transaction_id = source_transaction_id JOIN snap b ON b.transaction_id = target_transaction_id AND a.snapshot_index = b.snapshot_index) AS num_edges",
    "account_index_tables": with_(EVENTS, _DICT) + "SELECT transaction_id, a.k AS source_index, b.k AS target_index, round(CAST(CAST(amount AS FLOAT) AS DOUBLE), 3) AS amount, t_us * 1000 AS edge_time, label AS y FROM ev JOIN dc a ON a.node_id = source JOIN dc b ON b.node_id = target",
    "account_node_table": with_(EVENTS, _DICT) + "SELECT node_id, k AS node_index, 0 AS width FROM dc",
    "transaction_node_table": with_(EVENTS, _TX_INDEX) + "SELECT transaction_id, k AS node_index, round(CAST(CAST(amount AS FLOAT) AS DOUBLE), 3) AS amount, t_us * 1000 AS node_time, label AS y FROM tx",
    "transaction_edge_table": with_(EVENTS, _TX_INDEX, successors("e", "ev", US_4H)) + "SELECT a.k AS source_index, b.k AS target_index, edge_us * 1000 AS edge_time FROM e JOIN tx a ON a.transaction_id = source_transaction_id JOIN tx b ON b.transaction_id = target_transaction_id",
    "event_table": with_(EVENTS, _DICT) + "SELECT row_number() OVER (ORDER BY t_us, seq) - 1 AS seq, a.k AS src, b.k AS dst, t_us * 1000 AS t, round(CAST(CAST(amount AS FLOAT) AS DOUBLE), 3) AS amount, label AS y FROM ev JOIN dc a ON a.node_id = source JOIN dc b ON b.node_id = target",
    "sorted_nodes": with_(EVENTS, _DICT) + "SELECT node_id, k AS position FROM dc",
    "relaxed_concat": "SELECT k, s, \"only\", round(sum(v), 6) AS v, count(*) AS n FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS DOUBLE) AS v, o_orderstatus AS s, NULL AS \"only\" FROM orders UNION ALL SELECT l_orderkey, CAST(l_quantity AS DOUBLE), CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem) GROUP BY ALL",
    "usable_rows": with_(EVENTS) + "SELECT transaction_id, label FROM ev WHERE seq % 7 <> 0 AND seq % 5 <> 0 ORDER BY t_us, seq LIMIT 1000",
    "scalar_forms": "SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS day_us, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS number, CAST(CAST(o_orderkey * 1.5 AS FLOAT) AS DOUBLE) AS gap_s, round(greatest(least(o_totalprice, 200000), 1000), 4) AS held, CAST(ceil(o_orderkey / 1000) AS BIGINT) AS thousands FROM orders",
    "sql_functions": with_(EVENTS) + "SELECT seq, round(1 / (1 + exp(-(amount - 10))), 6) AS risk, round(CASE WHEN label = 0 THEN 0 ELSE amount / label END, 6) AS per, source, CASE WHEN trunc(amount) >= 20 THEN 2 WHEN trunc(amount) >= 5 THEN 1 WHEN trunc(amount) >= 2 THEN 0 ELSE -1 END AS bucket FROM ev",
    "budget_fractions": with_(EVENTS, _score(0.98), "bg AS (SELECT CAST(ceil(0.01 * count(*)) AS BIGINT) AS low, CAST(ceil(0.1 * count(*)) AS BIGINT) AS high FROM sc)", "o AS (SELECT label, row_number() OVER (ORDER BY score DESC, seq) AS rn FROM sc)",
        "ak AS (SELECT k, sum(label) / k AS p, sum(label) / (SELECT sum(label) FROM sc) AS r FROM o JOIN (SELECT low AS k FROM bg UNION ALL SELECT high FROM bg) ON rn <= k GROUP BY k)",
        "m AS (SELECT k, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f, round(p / (SELECT avg(label) FROM sc), 6) AS l FROM ak)",
    ) + "SELECT low, high, a.p AS precision_low, a.r AS recall_low, a.f AS f1_low, a.l AS lift_low, b.p AS precision_high, b.r AS recall_high, b.f AS f1_high, b.l AS lift_high FROM bg JOIN m a ON a.k = low JOIN m b ON b.k = high",
    "mergeable_counts": with_(EVENTS, _score(0.98)) + "SELECT * FROM th",
    "guard_errors": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{_KINDS.get(n, 'ValueError')}')" for n in _GUARDS) + ") t(name, error)",
    "streaming_sliding_flows": with_(EVENTS, f"x AS (SELECT *, t_us - t_us % {DAY} - d * {DAY} AS window_us FROM ev, (SELECT unnest([0, 1]) AS d))") + "SELECT window_us, account, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in, round(coalesce(sum(amount) FILTER (o = 1), 0), 6) AS amount_out, round(coalesce(sum(amount) FILTER (o = 0), 0), 6) AS amount_in FROM (SELECT window_us, source AS account, 1 AS o, amount FROM x UNION ALL SELECT window_us, target, 0, amount FROM x) GROUP BY ALL",
    "stream_account_state": with_(EVENTS) + _ROLLING,
}
