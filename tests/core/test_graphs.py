import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.operators.graphs import account_graph, event_stream, out_of_order, precomputed_graph, successor_edges, transaction_graph
from flowlens.plans.spec import GraphSpec, TensorSpec, prepare_graph, tensor_tables

from .helpers import at, day

HOUR = timedelta(hours=1)


def transfers(spark, rows):
    return spark.createDataFrame([(*r, 10.0, 0) for r in rows], "transaction_id string, source string, target string, timestamp timestamp, amount double, label int").coalesce(1)


def edges(graph):
    return sorted((r.source_transaction_id, r.target_transaction_id, r.via_account, r.time_delta_us // 60_000_000) for r in graph.edges.collect())


def test_parallel_edges_stay(spark):
    g = account_graph(transfers(spark, [("t1", "A", "B", at("09:00")), ("t2", "A", "B", at("09:05")), ("t3", "B", "C", at("09:10"))]))
    assert sorted(r.node_id for r in g.nodes.collect()) == ["A", "B", "C"] and g.edges.count() == 3


def test_successors_within_delta(spark):
    t = transfers(spark, [("t1", "A", "B", at("09:00")), ("t2", "B", "C", at("09:20")), ("t3", "B", "D", at("10:00")), ("t4", "X", "B", at("09:30"))])
    assert edges(transaction_graph(t, HOUR)) == [("t1", "t2", "B", 20), ("t1", "t3", "B", 60), ("t4", "t3", "B", 30)]


@pytest.mark.parametrize("rows, hours", [
    ([("t1", "A", "B", at("09:00")), ("t2", "B", "C", at("10:01"))], 1),
    ([("t1", "A", "B", at("10:00")), ("t2", "B", "C", at("10:00")), ("t3", "B", "D", at("09:00"))], 2),
    ([("t1", "A", "B", at("10:00"))], 0),
])
def test_no_successors(spark, rows, hours):
    g = transaction_graph(transfers(spark, rows), timedelta(hours=hours))
    assert g.edges.columns == ["source_transaction_id", "target_transaction_id", "via_account", "time_delta_us"] and g.edges.count() == 0


def test_ids_are_repaired(spark):
    t = transfers(spark, [("duplicate", "A", "B", at("09:00")), ("duplicate", "B", "C", at("09:10")), (None, "C", "D", at("09:20"))])
    assert edges(transaction_graph(t, HOUR)) == [("tx_0", "tx_1", "B", 10), ("tx_1", "tx_2", "C", 10)]


def test_whole_days_are_days(spark):
    t = transfers(spark, [("t1", "A", "B", day(1)), ("t2", "B", "C", day(2)), ("t3", "B", "D", day(3))])
    assert [e[:2] for e in edges(transaction_graph(t, timedelta(days=1)))] == [("t1", "t2")]


@pytest.mark.parametrize("bucketed", [True, False])
def test_random_transfers_against_all_pairs(spark, bucketed):
    r = random.Random(7)
    rows = [(str(k), str(r.randrange(12)), str(r.randrange(12)), r.randrange(2000)) for k in range(500)]
    df = spark.createDataFrame(rows, "transaction_id string, source string, target string, t_us long")
    got = sorted((x[0], x[1], x[3]) for x in successor_edges(df, 100, bucketed=bucketed).collect())
    assert got == sorted((a[0], b[0], b[3] - a[3]) for a in rows for b in rows if a[2] == b[1] and a[3] < b[3] <= a[3] + 100)


def test_untimed_graphs_leave_times_alone(spark):
    df = spark.createDataFrame([("A", "B", "2022/09/01 00:20")], ["source", "target", "timestamp"])
    assert account_graph(df).edges.first().timestamp == "2022/09/01 00:20"


def test_date_and_time_in_graphs(spark):
    df = spark.createDataFrame([("t1", "A", "B", "2025-01-01", "09:00:00"), ("t2", "B", "C", "2025-01-01", "09:30:00")], ["id", "source", "target", "Date", "Time"])
    assert [e[3] for e in edges(transaction_graph(df, HOUR))] == [30]


def test_metadata_keeps_the_first_row(spark):
    t = transfers(spark, [("t1", "A", "B", at("09:00"))])
    meta = spark.createDataFrame([(" A ", 1, "x"), ("A", 2, "y"), ("Z", 3, "z")], ["Account Number", "Bank ID", "Entity ID"]).coalesce(1)
    got = {r.node_id: (r["Bank ID"], r["Entity ID"]) for r in account_graph(t, metadata=meta).nodes.collect()}
    assert got == {"A": (1, "x"), "B": (None, None)}


def test_rows_without_ends_or_times_fall_away(spark):
    rows = [("t1", "A", " ", at("09:00")), ("t2", None, "B", at("09:00")), ("t3", "A", "B", None), ("t4", "A", "B", at("09:00"))]
    t = transfers(spark, rows)
    assert account_graph(t).edges.count() == 2 and account_graph(t, timed=True).edges.count() == 1


def test_errors(spark):
    with pytest.raises(ValueError):
        account_graph(spark.createDataFrame([(1.0,)], ["amount"]))
    t = transfers(spark, [("t1", "A", "B", at("09:00"))])
    with pytest.raises(ValueError):
        account_graph(t, source="nowhere")
    with pytest.raises(ValueError):
        transaction_graph(t.drop("timestamp"), HOUR)
    with pytest.raises(ValueError):
        transaction_graph(t, -HOUR)


def test_precomputed(spark):
    nodes = spark.createDataFrame([(" 1 ", 1), ("2", 2)], ["txId", "step"])
    links = spark.createDataFrame([("1", "2", 0.5)], ["txId1", "txId2", "w"])
    names = {"node_id": "txId", "edge_source": "txId1", "edge_target": "txId2"}
    g = precomputed_graph(nodes, links, **names, time="step", step_size=timedelta(days=1))
    assert g.edges.first().asDict() | {"w": 0.5} == g.edges.first().asDict() and g.edges.first().edge_relation == "precomputed"
    assert g.nodes.orderBy("step").first().timestamp == datetime(1970, 1, 2)
    with pytest.raises(ValueError):
        precomputed_graph(nodes, spark.createDataFrame([("1", "9")], ["txId1", "txId2"]), **names)
    with pytest.raises(ValueError):
        precomputed_graph(nodes, links, **names, time="step")
    with pytest.raises(ValueError):
        precomputed_graph(nodes.unionByName(nodes), links, **names)


def test_stream_order_and_guard(spark):
    t = transfers(spark, [("t2", "A", "B", day(2)), ("t1", "A", "B", day(1)), ("t3", "B", "C", day(3)), ("t1b", "A", "B", day(1))])
    s = event_stream(t)
    assert [r.transaction_id for r in s.events.orderBy("seq").collect()] == ["t1", "t1b", "t2", "t3"]
    assert out_of_order(s.events).count() == 0 and out_of_order(s.events, strict=True).count() == 1


def test_specifications(spark):
    t = transfers(spark, [("t1", "A", "B", day(1)), ("t2", "B", "C", day(2))])
    with pytest.raises(NotImplementedError):
        GraphSpec("transaction", "snapshot", edge_delta=HOUR, bin_size=HOUR, stride=HOUR)
    for bad in ({"node_type": "account", "temporal": "snapshot"}, {"node_type": "account", "temporal": "static", "bin_size": HOUR}, {"node_type": "transaction", "temporal": "static"}, {"node_type": "account", "temporal": "static", "edge_delta": HOUR}):
        with pytest.raises(ValueError):
            GraphSpec(**bad)
    two = timedelta(days=2)
    assert prepare_graph(t, GraphSpec("transaction", "static", edge_delta=two)).edges.count() == 1
    assert prepare_graph(t, GraphSpec("account", "static")).edges.count() == 2
    assert prepare_graph(t, GraphSpec("account", "event_stream")).events.count() == 2
    snap = prepare_graph(t, GraphSpec("account", "snapshot", bin_size=timedelta(days=1), stride=timedelta(days=1), drop_last=False))
    assert snap.edges.select("snapshot_index").distinct().count() == 2


def test_tensor_tables(spark):
    t = transfers(spark, [("t1", "A", "B", day(1)), ("t2", "B", "C", day(2))])
    x = tensor_tables(prepare_graph(t, GraphSpec("transaction", "static", edge_delta=timedelta(days=2))), TensorSpec(node_features=("amount",), edge_features=("time_delta_us",), label="label"))
    assert [(r.node_index, r.x, r.y) for r in x["nodes"].orderBy("node_index").collect()] == [(0, [10.0], 0), (1, [10.0], 0)]
    e = x["edges"].first()
    assert (e.source_index, e.target_index) == (0, 1) and e.edge_time == x["nodes"].where("node_index = 1").first().node_time
    a = tensor_tables(prepare_graph(t, GraphSpec("account", "static")), TensorSpec(edge_features=("amount",), label="label"))
    assert a["nodes"].count() == 3 and a["edges"].where("source_index != target_index").count() == 2
    s = tensor_tables(prepare_graph(t, GraphSpec("account", "event_stream")), TensorSpec(label="label"))
    assert s["events"].orderBy("t").first().msg == []
    with pytest.raises(TypeError):
        tensor_tables(prepare_graph(t, GraphSpec("account", "static")), TensorSpec(edge_features=("source",)))


def test_plans_push_down_and_prune(spark, tmp_path):
    transfers(spark, [("t1", "A", "B", day(1))]).write.parquet(f"{tmp_path}/t")
    plan = successor_edges(spark.read.parquet(f"{tmp_path}/t").withColumn("t_us", F.unix_micros("timestamp")), 10)._jdf.queryExecution().executedPlan().toString()
    assert "amount" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
