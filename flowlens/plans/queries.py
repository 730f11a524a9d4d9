"""The registered queries of the engine's own operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logical_time, parse_timestamp, sigmoid, time_us
from ..operators import features as gf
from ..operators import graphs, metrics, ordering, sampling, schema, splits, tensors, windows
from ..operators.shared import stage
from . import sql
from .sql import BINS, DAY, HOUR, US_4H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register f. Its plan is analysed, and so fixed, under UTC; the session's own time zone is back when it returns."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        zone = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            return f(spark, sf_dir)
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)

    QUERIES[f.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Floating-point results to six decimals, as sums add up in no fixed order; zero without a sign."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


# ---- the two transfer views ----


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transfers: user to the account in props.k; t_us, seq = event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    target = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("source"), target.alias("target"), F.col("ts").alias("timestamp"), time_us(F.col("ts")).alias("t_us"),
        F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("label"), F.col("event_id").alias("seq"),
    )


def item_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as transfers: part to supplier by day; ids repeat, times tie."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"), F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"),
        F.col("l_shipdate").alias("timestamp"), time_us(F.col("l_shipdate")).alias("t_us"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )


ITEM_ORDER = ["t_us", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "amount", "l_quantity"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_transfers(spark, sf_dir)
    return e.select("seq", (F.col("amount") / (F.col("amount") + 1)).alias("score"), "label")


# ---- schema ----


@query
def canonical_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = item_transfers(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("source"), F.lit("\t")).alias("Sender_account"), F.col("target").alias("Receiver.account"), F.date_format("timestamp", "yyyy-MM-dd").alias("Date"), F.lit("10:35:19").alias("Time"), F.col("amount").alias("Amount Received"),
        F.col("label").alias("Is Laundering"), *ITEM_ORDER[:5], "l_quantity",
    )
    out = schema.canonicalise(raw.withColumn("Amount", F.col("`Amount Received`")), order_by=["t_us", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "Amount", "l_quantity"])
    return out.select("transaction_id", "source", "target", time_us(F.col("timestamp")).alias("t_us"), "amount", "label")


@query
def clean_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("source"), F.col("o_orderkey").cast("string").alias("target"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("category"), F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("timestamp"),
    )
    out = schema.clean(raw)
    return rounded(out.select("source", "target", "amount", "category", time_us(F.col("timestamp")).alias("t_us"), "timestamp__raw"), "amount")


@query
def parse_time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    form = F.col("o_orderkey") % 5
    text = F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(form == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(form == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(form == 3, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")).otherwise("soon")
    return o.select("o_orderkey", time_us(parse_timestamp(text)).alias("t_us"))


@query
def logical_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    when = logical_time(F.col("l_linenumber"), timedelta(hours=1), datetime(2020, 1, 1, tzinfo=timezone.utc))
    return i.groupBy("l_linenumber", time_us(when).alias("t_us")).agg(F.count(F.lit(1)).alias("n"))


@query
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_transfers(spark, sf_dir)
    return schema.with_unique_ids(items, order_by=ITEM_ORDER).select("transaction_id", "source", "target", "t_us", "amount")


# ---- graphs ----


@query
def account_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.account_nodes(event_transfers(spark, sf_dir))


@query
def account_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.account_graph(event_transfers(spark, sf_dir), timed=True, order_by=["seq"])
    return g.edges.select("transaction_id", "source", "target", "t_us", "amount", "label")


@query
def account_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    meta = c.unionByName(c.withColumn("c_acctbal", F.lit(0.0))).select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("Account Number"), "c_acctbal", "c_mktsegment", "c_custkey", (F.col("c_acctbal") == 0).alias("late"))
    g = graphs.account_graph(event_transfers(spark, sf_dir), metadata=meta, metadata_order=["c_custkey", "late"], order_by=["seq"])
    return g.nodes.select("node_id", "c_acctbal", "c_mktsegment")


@query
def tx_graph_edges_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.transaction_graph(event_transfers(spark, sf_dir), timedelta(hours=4), order_by=["seq"]).edges


@query
def tx_graph_edges_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.transaction_graph(event_transfers(spark, sf_dir), timedelta(days=1), order_by=["seq"]).edges


@query
def tx_graph_edges_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graphs.transaction_graph(item_transfers(spark, sf_dir), timedelta(days=7), order_by=ITEM_ORDER).edges
    return e.groupBy("via_account", "time_delta_us").agg(F.count(F.lit(1)).alias("n"))


@query
def successor_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per account: transfers out and in, amounts, and how many hand money on within four hours."""
    t = event_transfers(spark, sf_dir)
    ends = t.select(F.explode(F.array(F.struct(F.col("source").alias("account"), F.lit(1).alias("out")), F.struct(F.col("target").alias("account"), F.lit(0).alias("out")))).alias("e"), "amount").select("e.account", "e.out", "amount")
    flow = ends.groupBy("account").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.coalesce(F.sum(F.when(F.col("out") == 1, F.col("amount"))), F.lit(0.0)).alias("amount_out"), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("amount"))), F.lit(0.0)).alias("amount_in"))
    passed = graphs.successor_edges(t, US_4H).groupBy(F.col("via_account").alias("account")).agg(F.count(F.lit(1)).alias("n_passed"), F.min("time_delta_us").alias("fastest_us"))
    return rounded(flow.join(passed, "account", "left").na.fill(0, ["n_passed"]), "amount_out", "amount_in")


@query
def unknown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("transaction_id"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("source_transaction_id"), F.col("l_partkey").cast("string").alias("target_transaction_id"))
    return graphs.unknown_endpoints(orders.where("transaction_id % 3 != 0"), items)


@query
def precomputed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    classes = o.where("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "1").when(F.col("o_orderstatus") == "F", "2").otherwise("unknown").alias("class"))
    nodes = o.join(classes, o.o_orderkey == classes.k, "left").withColumn("label", F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0)).withColumn("step", F.col("o_orderkey") % 49)
    keys = o.select("o_orderkey", "o_custkey")
    last = keys.withColumn("prev", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("prev IS NOT NULL")
    g = graphs.precomputed_graph(nodes, last, node_id="o_orderkey", edge_source="prev", edge_target="o_orderkey", time="step", step_size=timedelta(days=1))
    both = g.edges.select("source_transaction_id", "target_transaction_id", "edge_relation").join(g.nodes.select(F.col("transaction_id").alias("target_transaction_id"), time_us(F.col("timestamp")).alias("t_us"), "label"), "target_transaction_id")
    return both


@query
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graphs.event_stream(item_transfers(spark, sf_dir), order_by=ITEM_ORDER)
    return s.events.select("seq", "transaction_id", "source", "target", "t_us", "amount")


@query
def order_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the order of their keys whose ship date lies before that of the item ahead."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", time_us(F.col("l_shipdate")).alias("t_us"))
    rows = ordering.with_row_index(i, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], "seq")
    return graphs.out_of_order(rows.select("seq", "t_us"))


# ---- tensors ----


@query
def edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    nodes = tensors.node_index(graphs.account_nodes(t).withColumn("k", F.col("node_id").cast("long")), [F.col("k")])
    coded = tensors.encode_edges(t, nodes, source="source", target="target", id_col="node_id", name="node_index")
    return coded.select("seq", "source_index", "target_index")


@query
def edge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    e = tensors.edge_times(graphs.successor_edges(t, US_4H), t)
    return e.select("source_transaction_id", "target_transaction_id", tensors.time_ns(F.col("edge_us")).alias("edge_time"))


@query
def temporal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    nodes = tensors.node_index(graphs.account_nodes(t).withColumn("k", F.col("node_id").cast("long")), [F.col("k")], name="code")
    out = tensors.temporal_table(t, nodes, message=["amount", "label"], label="label")
    return out.select("seq", "src", "dst", "t", F.round(F.col("msg")[0].cast("double"), 3).alias("m0"), F.col("msg")[1].cast("double").alias("m1"), "y")


@query
def account_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.account_dictionary(item_transfers(spark, sf_dir))


# ---- windows ----


def _snapshot_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("snapshot_index").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("snapshot_index", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("amount").alias("amount"))
    return rounded(e.join(n, "snapshot_index"), "amount")


@query
def account_snapshots_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot_sizes(*windows.account_snapshots(event_transfers(spark, sf_dir), bin_us=DAY, stride_us=DAY))


@query
def account_snapshots_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot_sizes(*windows.account_snapshots(event_transfers(spark, sf_dir), bin_us=3 * DAY, stride_us=2 * DAY, drop_last=False))


@query
def account_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = windows.account_snapshots(event_transfers(spark, sf_dir), bin_us=2 * DAY, stride_us=DAY)
    return edges.select("snapshot_index", "transaction_id")


def _tx_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = event_transfers(spark, sf_dir)
    return windows.transaction_snapshots(t, graphs.successor_edges(t, US_4H), bin_us=2 * DAY, stride_us=2 * DAY, context_us=US_4H)


@query
def tx_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx_snapshots(spark, sf_dir)[0].select("snapshot_index", "transaction_id", "is_target")


@query
def tx_snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx_snapshots(spark, sf_dir)[1].select("snapshot_index", "source_transaction_id", "target_transaction_id")


@query
def static_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.static_windows(item_transfers(spark, sf_dir), window_us=90 * DAY, lookback_us=7 * DAY)
    return out.groupBy("window_id", "is_target").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"))


@query
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = windows.account_snapshots(event_transfers(spark, sf_dir), bin_us=DAY, stride_us=DAY)
    return windows.context_windows(edges.select("snapshot_index").distinct(), context=3)


@query
def disjoint_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = windows.account_snapshots(event_transfers(spark, sf_dir), bin_us=DAY, stride_us=DAY)
    return windows.disjoint_offsets(nodes.withColumn("batch", F.floor((F.col("snapshot_index") - 1) / 4)), batch_col="batch", group_col="snapshot_index")


@query
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordering.with_row_index(item_transfers(spark, sf_dir), [F.col(c) for c in ITEM_ORDER], "seq")
    return rounded(s.groupBy(windows.batch_of(F.col("seq"), 1024).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("low"), F.max("t_us").alias("high"), F.sum("amount").alias("amount")), "amount")


# ---- splits ----


@query
def induced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    train_end, validation_end = splits.fraction_cutoffs(t)
    _, edges = splits.induced_split(t, graphs.successor_edges(t, DAY), train_end=train_end, validation_end=validation_end)
    return edges.select("split", "source_transaction_id", "target_transaction_id")


@query
def node_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    train_end, validation_end = splits.fraction_cutoffs(t)
    return splits.node_masks(t, train_end=train_end, validation_end=validation_end).select("transaction_id", "train_mask", "validation_mask", "test_mask")


@query
def count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ordering.with_row_index(item_transfers(spark, sf_dir), [F.col(c) for c in ITEM_ORDER], "seq")
    return splits.count_split(s).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("low"), F.max("t_us").alias("high"))


@query
def time_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return splits.time_bands(t, bands=6, limit=600, order_by=[F.col("seq")]).select("band", "transaction_id")


# ---- metrics ----


@query
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.threshold_metrics(scored(spark, sf_dir), 0.98)
    return rounded(out, *[c for c in out.columns if c.startswith("threshold_")])


@query
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(scored(spark, sf_dir)), "average_precision", "roc_auc")


@query
def investigation_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.at_k(scored(spark, sf_dir), [10, 50, 200], tie=F.col("seq"))
    return rounded(out, "precision", "recall", "f1", "lift")


@query
def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.evaluate(scored(spark, sf_dir), tie=F.col("seq"), threshold=0.98, budgets=[25])
    return rounded(out, *[c for c in out.columns if c not in ("tp", "fp", "tn", "fn")])


@query
def risk_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return rounded(t.select("seq", sigmoid(F.log1p(F.abs(F.col("amount"))) - 3).alias("risk")), "risk")


# ---- graph features ----

BATCH = 512
CONFIGS = {
    "gfp_fan_in": gf.FeatureConfig(fan_in=gf.Pattern(DAY, BINS)),
    "gfp_fan_out": gf.FeatureConfig(fan_out=gf.Pattern(DAY, BINS)),
    "gfp_degree_in": gf.FeatureConfig(degree_in=gf.Pattern(DAY, BINS)),
    "gfp_degree_out": gf.FeatureConfig(degree_out=gf.Pattern(DAY, BINS)),
    "gfp_scatter_gather": gf.FeatureConfig(scatter_gather=gf.Pattern(12 * HOUR, (2, 3)), retention=DAY),
    "gfp_length_cycle": gf.FeatureConfig(length_cycle=gf.Pattern(12 * HOUR, (2, 3, 4), 4), retention=DAY),
    "gfp_temporal_cycle": gf.FeatureConfig(temporal_cycle=gf.Pattern(12 * HOUR, (2, 3, 4)), retention=DAY),
    "gfp_statistics": gf.FeatureConfig(statistics_window=DAY, statistics=gf.STATISTICS, value_columns=("amount",), retention=2 * DAY),
}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transfers(spark, sf_dir).select(F.col("transaction_id").alias("edge_id"), "source", "target", F.col("t_us").alias("t"), "seq", "amount")


def _feature_query(name: str, config: gf.FeatureConfig) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = gf.graph_features(config, feature_rows(spark, sf_dir), batch_size=BATCH).select("seq", *config.columns())
        return rounded(out, *[c for c in config.columns() if name == "gfp_statistics" and "fan" not in c and "degree" not in c])

    f.__name__ = name
    query(f)


for _name, _config in CONFIGS.items():
    _feature_query(_name, _config)


@query
def gfp_single_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = gf.FeatureConfig(fan_in=gf.Pattern(DAY, BINS), degree_out=gf.Pattern(DAY, BINS), retention=60 * DAY)
    return gf.graph_features(config, feature_rows(spark, sf_dir)).select("seq", *config.columns())


@query
def gfp_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = gf.FeatureConfig(fan_in=gf.Pattern(DAY, BINS), statistics_window=DAY, statistics=("fan", "degree", "sum"), value_columns=("amount",))
    out = gf.causal_features(config, feature_rows(spark, sf_dir), strict=False)
    return rounded(out.select("seq", *config.columns()), *[c for c in config.columns() if "sum" in c])


@query
def active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = gf.FeatureConfig(fan_in=gf.Pattern(DAY, BINS), max_edges=250)
    return gf.active_edges(config, feature_rows(spark, sf_dir)).select("edge_id")


# ---- sampling ----


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transfers(spark, sf_dir).withColumnRenamed("seq", "event_id")


def _error_ids(t: DataFrame, name: str) -> DataFrame:
    return t.where("label = 1").select(name)


@query
def causal_neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return sampling.causal_nodes(t, graphs.successor_edges(t, DAY), _error_ids(t, "transaction_id"), fanout=[5])


@query
def causal_neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return sampling.causal_nodes(t, graphs.successor_edges(t, DAY), _error_ids(t, "transaction_id"), fanout=[3, 2])


@query
def causal_neighbors_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return sampling.causal_nodes_in_windows(t, graphs.successor_edges(t, DAY), _error_ids(t, "transaction_id"), window_us=2 * DAY, lookback_us=12 * HOUR, fanout=[3])


@query
def causal_event_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return sampling.causal_events(e, _error_ids(e, "event_id"), fanout=[4, 2])


@query
def uniform_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_transfers(spark, sf_dir)
    return sampling.causal_nodes(t, graphs.successor_edges(t, DAY), _error_ids(t, "transaction_id"), fanout=[3], strategy="uniform", seed=7)


@query
def recent_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.recent_neighbors(_events(spark, sf_dir), size=5)


@query
def timestamp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = item_transfers(spark, sf_dir).select("t_us", "amount")
    cut = t.agg(F.percentile_approx("t_us", 0.5, 100000)).first()[0]
    groups = sampling.timestamp_groups(t.where(F.col("t_us") < cut), t.where(F.col("t_us") >= cut))
    sizes = groups.groupBy("group_id", "t_us").agg(F.count(F.lit(1)).alias("n"), F.count_if("target_event_mask").alias("n_targets"))
    return sizes.select("group_id", "t_us", "n", (F.col("n_targets").isin(0) | (F.col("n_targets") == F.col("n"))).alias("pure"))


@query
def mean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    found = sampling.causal_events(e, _error_ids(e, "event_id"), fanout=[4])
    return rounded(sampling.mean_messages(found, e, value_col="amount"), "mean_message")


@query
def endpoint_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.endpoint_means(item_transfers(spark, sf_dir), value_col="amount"), "mean_value")


# ---- experiments and streams ----


@query
def tabular_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier on causal features of the first three fifths of time, evaluated on the rest."""
    from .experiment import TabularExperiment, baseline

    config = gf.FeatureConfig(statistics_window=DAY, statistics=("fan", "degree", "sum"), value_columns=("amount",))
    t = event_transfers(spark, sf_dir)
    x = gf.causal_features(config, feature_rows(spark, sf_dir), strict=False).join(t.select("seq", "label", "t_us"), "seq")
    x = stage(x, "experiment")  # fitting and each of the metrics read it again
    train_end, _ = splits.fraction_cutoffs(t)
    model = TabularExperiment(baseline("logistic", maxIter=20), ["amount", *config.columns()]).fit(x.where(F.col("t_us") < train_end))
    return model.evaluate(x.where(F.col("t_us") >= train_end), tie="seq", threshold=0.2, budgets=[25])


@query
def streaming_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flows per account from a stream over the events' folder, run until it is used up."""
    from ..streaming import windowed_flows
    from .stream_run import drain

    flows = drain(windowed_flows(event_source(spark, sf_dir), window="1 day"), ["window_start", "window_end", "account"])
    return rounded(flows.select(time_us(F.col("window_start")).alias("window_us"), "account", "n_out", "n_in", "amount_out", "amount_in"), "amount_out", "amount_in")


def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of transfers."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream watches folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("source"), F.get_json_object("props", "$.k").alias("target"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("amount"))


# they use what is defined above
from . import more_queries, source_queries  # noqa: E402

SQL = {n: s for n, s in (sql.SQL | more_queries.SQL | source_queries.SQL).items() if n in QUERIES}
