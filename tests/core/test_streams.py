from datetime import datetime, timedelta

import numpy as np
import pytest

from flowlens.plans.stream_run import drain
from flowlens.streaming import ordered_or_late, recent_neighbors_stream, rolling_account_state, windowed_flows
from flowlens.streaming.transfers import rolling_counts

SCHEMA = "transaction_id string, source string, target string, timestamp timestamp, amount double"
T0 = datetime(2025, 1, 1)
KEYS = ["window_start", "window_end", "account"]
ROWS = [("t1", "A", "B", 0, 1.0), ("t2", "A", "C", 10, 2.0), ("t3", "B", "A", 70, 4.0), ("t4", "A", "B", 75, 8.0), ("t5", "A", "D", 75, 16.0)]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, s, t, T0 + timedelta(minutes=m), a) for i, s, t, m, a in ROWS]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def test_windowed_flows(stream):
    got = {(r.window_start.hour, r.account): (r.n_out, r.n_in, r.amount_out, r.amount_in) for r in drain(windowed_flows(stream, window="1 hour"), KEYS).collect()}
    assert got == {(0, "A"): (2, 0, 3.0, 0.0), (0, "B"): (0, 1, 0.0, 1.0), (0, "C"): (0, 1, 0.0, 2.0), (1, "A"): (2, 1, 24.0, 4.0), (1, "B"): (1, 1, 4.0, 8.0), (1, "D"): (0, 1, 0.0, 16.0)}
    assert drain(windowed_flows(stream, window="1 hour", slide="30 minutes"), KEYS).count() > len(got)


def test_rolling_state(stream):
    got = {r.transaction_id: (r.fan_out, r.degree_out, r.amount_out) for r in drain(rolling_account_state(stream, retention_us=3_600_000_000)).collect()}
    assert got == {"t1": (1, 1, 1.0), "t2": (2, 2, 3.0), "t3": (1, 1, 4.0), "t4": (1, 1, 8.0), "t5": (2, 2, 24.0)}
    few = {r.transaction_id: r.degree_out for r in drain(rolling_account_state(stream, retention_us=10**12, max_edges=2)).collect()}
    assert few["t5"] == 2


def test_rolling_state_has_no_count_bound(spark, tmp_path):
    rows = [(f"t{k:04}", "A", f"b{k}", T0 + timedelta(seconds=k), 1.0) for k in range(1_100)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = drain(rolling_account_state(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), retention_us=3_600_000_000)).where("transaction_id = 't1099'").first()
    assert (got.fan_out, got.degree_out, got.amount_out) == (1_100, 1_100, 1_100.0)


def test_recent_neighbors(stream):
    got = {(r.transaction_id, r.account): r.recent for r in drain(recent_neighbors_stream(stream, size=2)).collect()}
    assert got[("t1", "A")] == [] and got[("t2", "A")] == ["B"] and got[("t3", "A")] == ["C", "B"]
    assert got[("t4", "A")] == got[("t5", "A")] == ["B", "C"] and got[("t4", "B")] == ["A", "A"]


def test_order_guard(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(hours=1),)], "timestamp timestamp")
    limit = int((T0 + timedelta(minutes=30) - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert ordered_or_late(df, limit).count() == 1 and ordered_or_late(df, None).count() == 0


def test_bad_arguments(stream):
    with pytest.raises(ValueError):
        rolling_account_state(stream, retention_us=0)
    with pytest.raises(ValueError):
        recent_neighbors_stream(stream, size=0)


@pytest.mark.parametrize("most", [-1, 1, 3])
def test_rolling_counts_equal_a_walk(most):
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        t, who, x = np.sort(rng.integers(0, 30, n)), rng.integers(0, 5, n).astype(str), rng.integers(1, 9, n).astype(float)
        kept, slow = [], []
        for row in zip(t, who, x):
            kept = [e for e in [*kept, row] if e[0] > row[0] - 7]
            kept = kept[-most:] if most > 0 else kept
            slow.append((len({e[1] for e in kept}), len(kept), sum(e[2] for e in kept)))
        assert list(zip(*(a.tolist() for a in rolling_counts(t, who, x, 7, most)))) == slow


def test_drain_keeps_the_last_version_of_a_row(spark, tmp_path):
    """Two files in two batches: a window that both touch counts once, with what both say."""
    for k in (0, 1):
        spark.createDataFrame([(f"t{k}", "A", "B", T0 + timedelta(minutes=k), 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(windowed_flows(stream, window="1 hour"), KEYS).collect()
    assert sorted((r.account, r.n_out, r.n_in) for r in got) == [("A", 2, 0), ("B", 0, 2)]
