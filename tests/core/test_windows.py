from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flowlens.operators import splits, windows
from flowlens.operators.graphs import successor_edges

from .helpers import day, us

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def chain(spark):
    names = "ABCDEFG"
    rows = [(f"t{k}", names[k - 1], names[k], us(day(k)), 10.0 * k, int(k in (3, 5))) for k in range(1, 7)]
    t = spark.createDataFrame(rows, "transaction_id string, source string, target string, t_us long, amount double, label int").cache()
    return t, successor_edges(t, 2 * DAY)


def test_induced_split(chain):
    nodes, edges = splits.induced_split(*chain, train_end=us(day(3)), validation_end=us(day(5)))
    assert {(r.split, r.transaction_id) for r in nodes.collect()} == {("train", "t1"), ("train", "t2"), ("validation", "t3"), ("validation", "t4"), ("test", "t5"), ("test", "t6")}
    assert {r.split: r["count"] for r in edges.groupBy("split").count().collect()} == {"train": 1, "validation": 1, "test": 1}
    assert chain[1].count() == 5


def test_masks_are_disjoint(chain):
    m = splits.node_masks(chain[0], train_end=us(day(3)), validation_end=us(day(5))).collect()
    assert all(r.train_mask + r.validation_mask + r.test_mask == 1 for r in m)
    with pytest.raises(ValueError):
        splits.split_of(F.col("t_us"), 5, 5)


def test_sliding_snapshots(chain):
    nodes, edges = windows.transaction_snapshots(*chain, bin_us=3 * DAY, stride_us=2 * DAY, start_us=us(day(1)), end_us=us(day(7)))
    got = {k: sorted(r.transaction_id for r in nodes.where(f"snapshot_index = {k}").collect()) for k in (1, 2, 3)}
    assert got == {1: ["t1", "t2", "t3"], 2: ["t3", "t4", "t5"], 3: []}
    assert {(r.source_transaction_id, r.target_transaction_id) for r in edges.where("snapshot_index = 1").collect()} == {("t1", "t2"), ("t2", "t3")}


def test_context_before_targets(chain):
    nodes, _ = windows.transaction_snapshots(*chain, bin_us=2 * DAY, stride_us=2 * DAY, context_us=2 * DAY, start_us=us(day(3)), end_us=us(day(5)))
    assert [(r.transaction_id, r.is_target) for r in nodes.orderBy("t_us").collect()] == [("t1", False), ("t2", False), ("t3", True), ("t4", True)]


def test_account_snapshots(spark):
    rows = [("t2", "A", "B", us(day(2))), ("t1", "A", "B", us(day(1))), ("t3", "B", "C", us(day(3)))]
    e = spark.createDataFrame(rows, "transaction_id string, source string, target string, t_us long")
    nodes, edges = windows.account_snapshots(e, bin_us=2 * DAY, stride_us=2 * DAY, start_us=us(day(1)), end_us=us(day(4)), drop_last=False)
    assert sorted((r.snapshot_index, r.transaction_id) for r in edges.collect()) == [(1, "t1"), (1, "t2"), (2, "t3")]
    assert sorted((r.snapshot_index, r.node_id) for r in nodes.collect()) == [(1, "A"), (1, "B"), (2, "B"), (2, "C")]
    assert windows.account_snapshots(e.limit(0), bin_us=DAY, stride_us=DAY)[1].count() == 0
    gap = windows.account_snapshots(e.where("transaction_id != 't2'"), bin_us=DAY, stride_us=DAY, drop_last=False)[1]
    assert sorted(r.snapshot_index for r in gap.collect()) == [1, 2]  # empty windows have no number
    with pytest.raises(ValueError):
        windows.account_snapshots(e, bin_us=0, stride_us=DAY)


def test_windows_against_a_loop(spark):
    times = [0, 1, 5, 9, 10, 17, 30, 31]
    df = spark.createDataFrame([(t,) for t in times], "t_us long")
    for size, stride, context, drop in [(4, 4, 0, True), (5, 2, 3, False), (3, 7, 4, True), (50, 5, 0, True), (50, 5, 0, False), (4, 4, 20, False)]:
        got = sorted((r.window_start, r.window_end, r.t_us, r.is_target) for r in windows.in_windows(df, bin_us=size, stride_us=stride, start_us=0, end_us=32, drop_last=drop, context_us=context).collect())
        expected, s = [], 0
        while s < 32 and not (drop and s + size > 32):
            expected += [(s, min(s + size, 32), t, t >= s) for t in times if s - context <= t < min(s + size, 32)]
            s += stride
        assert got == sorted(expected), (size, stride, context, drop)


def test_static_windows(spark):
    df = spark.createDataFrame([(k, k * DAY) for k in (0, 1, 2)], "k int, t_us long")
    got = sorted((r.window_id, r.k, r.is_target) for r in windows.static_windows(df, window_us=DAY, lookback_us=DAY).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (2, 2, True)]


def test_context_windows_and_offsets(spark):
    s = spark.createDataFrame([(k,) for k in (1, 2, 4, 7)], "snapshot_index int")
    got = sorted((r.target_index, r.position, r.context_index) for r in windows.context_windows(s, context=2).collect())
    assert got == [(4, 0, 1), (4, 1, 2), (7, 0, 2), (7, 1, 4)]
    n = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 3)], "b int, g int")
    assert sorted((r.b, r.g, r.num_nodes, r.node_offset) for r in windows.disjoint_offsets(n, batch_col="b", group_col="g").collect()) == [(0, 1, 2, 0), (0, 2, 1, 2), (1, 3, 1, 0)]


def test_count_split_keeps_ties_together(spark):
    times = [1, 2, 3, 3, 3, 3, 4, 5, 6, 7]
    df = spark.createDataFrame(list(enumerate(times)), "seq long, t_us long")
    got = {r.seq: r.split for r in splits.count_split(df, train=Fraction(3, 10), validation=Fraction(8, 10)).collect()}
    assert [got[k] for k in range(10)] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2
    with pytest.raises(ValueError):
        splits.count_split(df.withColumn("t_us", F.lit(1)))


def test_time_bands(spark):
    df = spark.range(100).select("id", F.col("id").alias("t_us"))
    for last, most in ((True, 99), (False, 98)):
        got = splits.time_bands(df, bands=3, limit=6, order_by=[F.col("id")], keep_last=last).collect()
        assert sorted((r.band, r.id) for r in got) == [(0, 0), (0, 1), (1, 33), (1, 34), (2, 66), (2, 67)] and most
    assert splits.time_bands(df.limit(0), bands=3, limit=6, order_by=[F.col("id")]).count() == 0


def test_times_right_before_a_boundary_stay_there(spark):
    rows = spark.createDataFrame([(k * DAY + d, k, d) for k in range(8) for d in (0, 1, DAY // 2, DAY - 1)], "t_us long, k long, d long").withColumns({"source": F.lit("a"), "target": F.lit("b")})
    assert {(r.window_id, r.k) for r in windows.static_windows(rows, window_us=DAY).collect()} == {(k, k) for k in range(8)}
    for bin_days, stride_days in ((1, 1), (3, 2), (2, 1)):
        got = windows.account_snapshots(rows, bin_us=bin_days * DAY, stride_us=stride_days * DAY, start_us=0, end_us=8 * DAY)[1]
        starts = range(0, 8 - bin_days + 1, stride_days)
        want = sorted((n + 1, k, d) for n, s in enumerate(starts) for k in range(8) for d in (0, 1, DAY // 2, DAY - 1) if s <= k < s + bin_days)
        assert sorted((r.snapshot_index, r.k, r.d) for r in got.collect()) == want
    tagged = windows.in_windows(rows, bin_us=DAY, stride_us=DAY, start_us=DAY, end_us=3 * DAY, context_us=1)
    assert sorted((r.window_start // DAY, r.k, r.d, r.is_target) for r in tagged.where("d >= 1 AND d != 43200000000").collect()) == [(1, 0, DAY - 1, False), (1, 1, 1, True), (1, 1, DAY - 1, True), (2, 1, DAY - 1, False), (2, 2, 1, True), (2, 2, DAY - 1, True)]


def test_times_right_before_a_band_ends_stay_there(spark):
    span = 60 * DAY
    rows = spark.createDataFrame([(t,) for k in range(1, 6) for t in (k * span // 6 - 1, k * span // 6)] + [(0,), (span,)], "t_us long")
    got = splits.time_bands(rows, bands=6, limit=600, order_by=[F.col("t_us")])
    assert sorted((r.t_us, r.band) for r in got.collect()) == sorted([(0, 0), (span, 5)] + [(k * span // 6 - 1, k - 1) for k in range(1, 6)] + [(k * span // 6, k) for k in range(1, 6)])
    far = spark.createDataFrame([(-(1 << 61),), ((1 << 61),)], "t_us long")  # six times the span is more than a long holds
    assert sorted(r.band for r in splits.time_bands(far, bands=6, limit=600, order_by=[F.col("t_us")]).collect()) == [0, 5]
