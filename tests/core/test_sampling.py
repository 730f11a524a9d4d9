import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import sampling


def nodes_edges(spark, times, links):
    n = spark.createDataFrame([(str(k), t) for k, t in enumerate(times)], "transaction_id string, t_us long")
    e = spark.createDataFrame([(str(a), str(b)) for a, b in links], "source_transaction_id string, target_transaction_id string")
    return n, e


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "transaction_id string")


def test_context_is_strictly_earlier(spark):
    n, e = nodes_edges(spark, [0, 1, 2, 3, 2, 3], [(0, 4), (1, 4), (2, 4), (3, 4), (4, 5)])
    got = sampling.causal_nodes(n, e, seeds(spark, "4"), fanout=[-1]).collect()
    assert {r.context_id for r in got} == {"0", "1"}
    assert [r.context_id for r in sampling.causal_nodes(n, e, seeds(spark, "4"), fanout=[1]).collect()] == ["1"]


@pytest.mark.parametrize("fanout", [[2], [3, 2], [-1, 1, 2]])
def test_hops_against_a_loop(spark, fanout):
    r = random.Random(3)
    times = [r.randrange(30) for _ in range(60)]
    links = sorted({(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(300)) if times[a] < times[b]})
    n, e = nodes_edges(spark, times, links)
    ask = [str(k) for k in range(0, 60, 7)]
    got = sorted((x.seed_id, x.hop, x.frontier_id, x.context_id) for x in sampling.causal_nodes(n, e, seeds(spark, *ask), fanout=fanout).collect())
    expected = []
    for s in ask:
        frontier = {s}
        for hop, k in enumerate(fanout, 1):
            nxt = set()
            for f in frontier:
                c = sorted([str(a) for a, b in links if str(b) == f and times[a] < times[int(s)]], key=lambda a: (times[int(a)], a), reverse=True)
                for a in c if k == -1 else c[:k]:
                    expected.append((s, hop, f, a))
                    nxt.add(a)
            frontier = nxt
    assert got == sorted(expected)


def test_uniform_is_repeatable_and_eligible(spark):
    n, e = nodes_edges(spark, [*range(20), 50], [(k, 20) for k in range(20)])
    pick = lambda seed: {r.context_id for r in sampling.causal_nodes(n, e, seeds(spark, "20"), fanout=[5], strategy="uniform", seed=seed).collect()}
    assert pick(1) == pick(1) and len(pick(1)) == 5 and any(pick(1) != pick(k) for k in (2, 3, 4))


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, source string, target string, t_us long")


def test_event_context(spark):
    e = events(spark, [(0, "0", "5", 0), (1, "1", "5", 1), (2, "2", "5", 2), (3, "3", "5", 2)])
    got = sampling.causal_events(e, e.where("event_id = 3"), fanout=[5]).collect()
    assert sorted((r.account, r.event_us) for r in got) == [("5", 0), ("5", 1)]


def test_recent_neighbors_and_groups(spark):
    e = events(spark, [(0, "0", "1", 1), (1, "1", "0", 2), (2, "0", "2", 3), (3, "2", "0", 3), (4, "1", "3", 4), (5, "3", "1", 5)])
    first = sampling.recent_neighbors(e, size=2, until=F.col("t_us") < 2).where("account = '0'").collect()
    assert [(r.neighbor, r.event_id) for r in first] == [("1", 0)]
    last = sampling.recent_neighbors(e, size=2).where("account = '0'").orderBy("rank").collect()
    assert [(r.neighbor, r.event_id) for r in last] == [("2", 3), ("2", 2)]
    g = sampling.timestamp_groups(e.where("t_us <= 2"), e.where("t_us > 2")).collect()
    assert sorted((r.group_id, r.event_id, r.target_event_mask) for r in g) == [(0, 0, False), (1, 1, False), (2, 2, True), (2, 3, True), (3, 4, True), (4, 5, True)]
    with pytest.raises(ValueError):
        sampling.timestamp_groups(e.where("t_us <= 3"), e.where("t_us >= 3"))


def test_means(spark):
    e = events(spark, [(0, "a", "b", 1), (1, "b", "c", 1)]).withColumn("amount", F.lit(-1.0) * (F.col("event_id") + 1))
    s = spark.createDataFrame([(9, 0), (9, 1)], "target_id long, event_id long")
    assert sampling.mean_messages(s, e, value_col="amount").first().mean_message == pytest.approx((math.log(2) + math.log(3)) / 2)
    assert {r.account: (r.mean_value, r.n) for r in sampling.endpoint_means(e, value_col="amount").collect()} == {"a": (-1.0, 1), "b": (-1.5, 2), "c": (-2.0, 1)}


@pytest.mark.parametrize("fanout, strategy", [([], "last"), ([0], "last"), ([True], "last"), ([1], "newest")])
def test_bad_arguments(spark, fanout, strategy):
    n, e = nodes_edges(spark, [0], [(0, 0)])
    with pytest.raises(ValueError):
        sampling.causal_nodes(n, e, seeds(spark, "0"), fanout=fanout, strategy=strategy)
