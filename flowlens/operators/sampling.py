"""Neighbours strictly in the past, hop by hop with a limit for each seed and frontier node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running_sums, with_row_index
from .shared import stage
from .windows import induced, static_windows

_STRATEGIES = ("last", "uniform")


def _check(fanout: Sequence[int], strategy: str) -> None:
    if strategy not in _STRATEGIES:
        raise ValueError(f"strategy is one of {_STRATEGIES}")
    if not fanout or any(isinstance(k, bool) or (k < 1 and k != -1) for k in fanout):
        raise ValueError("fanout has a positive number, or -1 for all, for each hop")


def _pick(candidates: DataFrame, by: list[str], k: int, strategy: str, time_col: str, id_col: str, seed: int) -> DataFrame:
    if k == -1:
        return candidates
    order = [F.desc(time_col), F.desc(id_col)] if strategy == "last" else [F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*by, id_col]))), F.col(id_col)]
    # Catalyst keeps the first k of each group before the shuffle too (WindowGroupLimit), so a hub sends k rows a task
    return candidates.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def causal_nodes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, fanout: Sequence[int], strategy: str = "last", seed: int = 0) -> DataFrame:
    """Context of seed transfers in a transaction graph: seed_id, hop, frontier_id, context_id, context_us.

    Each hop follows incoming edges of the frontier to transfers strictly before the seed; of each frontier
    node those with the latest times stay (equal ones: the greatest id), or seeded-hash picks for uniform.
    nodes: transaction_id, t_us; edges: source_transaction_id, target_transaction_id; seeds: transaction_id.
    """
    _check(fanout, strategy)
    times = nodes.select(F.col("transaction_id").alias("context_id"), F.col("t_us").alias("context_us"))
    links = edges.select(F.col("target_transaction_id").alias("frontier_id"), F.col("source_transaction_id").alias("context_id")).join(times, "context_id")
    start = seeds.select("transaction_id").join(nodes.select("transaction_id", "t_us"), "transaction_id")
    frontier = start.select(F.col("transaction_id").alias("seed_id"), F.col("t_us").alias("seed_us"), F.col("transaction_id").alias("frontier_id"))
    out = None
    for hop, k in enumerate(fanout, 1):
        found = frontier.join(links, "frontier_id").where(F.col("context_us") < F.col("seed_us"))
        found = _pick(found, ["seed_id", "frontier_id"], k, strategy, "context_us", "context_id", seed).withColumn("hop", F.lit(hop))
        rows = found.select("seed_id", "hop", "frontier_id", "context_id", "context_us")
        out = rows if out is None else out.unionByName(rows)
        frontier = found.select("seed_id", "seed_us", F.col("context_id").alias("frontier_id")).distinct()
    return out


def causal_nodes_in_windows(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, window_us: int, lookback_us: int, fanout: Sequence[int], strategy: str = "last", seed: int = 0) -> DataFrame:
    """causal_nodes inside disjoint outer windows: window_id added, seeds are the targets of each window among seeds, and context
    lies within the window and its lookback."""
    tagged = static_windows(nodes, window_us=window_us, lookback_us=lookback_us)
    keyed = lambda c: F.struct("window_id", F.col(c).alias("id"))  # noqa: E731  a node counts once for each window
    own = tagged.select(keyed("transaction_id").alias("transaction_id"), "t_us")
    both = induced(tagged, edges, ["window_id"])
    links = both.select(keyed("source_transaction_id").alias("source_transaction_id"), keyed("target_transaction_id").alias("target_transaction_id"))
    targets = tagged.where("is_target").join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(keyed("transaction_id").alias("transaction_id"))
    out = causal_nodes(own, links, targets, fanout=fanout, strategy=strategy, seed=seed)
    return out.select("seed_id.window_id", F.col("seed_id.id").alias("seed_id"), "hop", F.col("frontier_id.id").alias("frontier_id"), F.col("context_id.id").alias("context_id"), "context_us")


def _last_before(past: DataFrame, frontier: DataFrame, k: int, order: list[str], at: str) -> DataFrame:
    """frontier rows (account, columns) joined with the last k rows of past (account, columns) of their account before their time, column at.

    Both are put into one order by account and time, so that a row of past has a number and a frontier row knows how many
    numbers lie before it. The k numbers before are then looked up as such: no account's history is joined or
    ranked, however long it is.
    """
    mine = [c for c in frontier.columns if c != "account"]
    rows = past.select("account", F.struct(*(c for c in past.columns if c != "account")).alias("__p"), F.lit(None).alias("__f"), F.col(order[0]).alias("__t"), F.col(order[1]).alias("__id"))
    asks = frontier.select("account", F.lit(None).alias("__p"), F.struct(*mine).alias("__f"), F.col(at).alias("__t"), F.lit(None).alias("__id"))
    both = rows.unionByName(asks).withColumn("__ask", F.col("__p").isNull())
    # at equal times frontier rows come first: only what is strictly before counts
    both = running_sums(both, [F.col("account"), F.col("__t"), F.desc("__ask"), F.col("__id")], {"__n": (~F.col("__ask")).cast("long")})
    found = both.where("NOT __ask").select(F.col("account").alias("__a"), (F.col("__n") - 1).alias("__at"), "__p.*")
    wanted = both.where("__ask AND __n > 0").select("account", "__f.*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__n") - k).cast("long"), F.col("__n") - 1)).alias("__at"))
    return wanted.join(found, "__at").where("account = __a").drop("__at", "__a")


def causal_events(events: DataFrame, targets: DataFrame, *, fanout: Sequence[int], strategy: str = "last", seed: int = 0) -> DataFrame:
    """Context of target events in an account graph: target_id, hop, account, event_id, event_us.

    Both endpoints of a target expand to events into them (source to target) strictly before it; each hop
    goes on from those events' sources. An event counts once for each target and hop.
    events: event_id, source, target, t_us; targets: event_id. The target itself is never its own context.
    """
    _check(fanout, strategy)
    past = events.select(F.col("target").alias("account"), F.col("source").alias("next"), "event_id", F.col("t_us").alias("event_us"))
    start = targets.select("event_id").join(events.select("event_id", "source", "target", "t_us"), "event_id")
    frontier = start.select(F.col("event_id").alias("target_id"), F.col("t_us").alias("target_us"), F.explode(F.array_distinct(F.array("source", "target"))).alias("account"))
    out = None
    for hop, k in enumerate(fanout, 1):
        if strategy == "last" and k != -1:
            found = _last_before(past, frontier, k, ["event_us", "event_id"], "target_us")
        else:
            found = frontier.join(past, "account").where(F.col("event_us") < F.col("target_us"))
            found = _pick(found, ["target_id", "account"], k, strategy, "event_us", "event_id", seed)
        found = found.withColumn("hop", F.lit(hop))
        if hop < len(fanout):
            found = stage(found, "context")  # the next hop and the result both read it
        rows = found.select("target_id", "hop", "account", "event_id", "event_us")
        out = rows if out is None else out.unionByName(rows)
        frontier = found.select("target_id", "target_us", F.col("next").alias("account")).distinct()
    return out


def causal_edges(edges: DataFrame, targets: DataFrame, *, fanout: Sequence[int], label: str | None = None, message: Sequence[str] = (), strategy: str = "last", seed: int = 0) -> DataFrame:
    """causal_events with what a model needs of the transfer that it predicts: target_time, target_label, target_message (an array), and source and target.

    edges and targets as there, edges also with the label and message columns.
    """
    found = causal_events(edges, targets, fanout=fanout, strategy=strategy, seed=seed)
    own = [F.col("event_id").alias("target_id"), F.col("source").alias("target_source"), F.col("target").alias("target_target"), F.col("t_us").alias("target_time")]
    own += [F.col(label).alias("target_label")] if label else []
    own += [F.array(*(F.col(c).cast("double") for c in message)).alias("target_message")] if message else []
    return found.join(edges.select(*own), "target_id")


def causal_events_in_windows(events: DataFrame, targets: DataFrame, *, window_us: int, lookback_us: int, fanout: Sequence[int], strategy: str = "last", seed: int = 0) -> DataFrame:
    """causal_events inside disjoint outer windows: window_id added; targets are those of each window, and context lies within the window and its lookback."""
    tagged = static_windows(events, window_us=window_us, lookback_us=lookback_us)
    keyed = lambda c: F.struct("window_id", F.col(c).alias("id")).alias(c)  # noqa: E731  an account or event is another one in each window
    own = tagged.select(keyed("event_id"), keyed("source"), keyed("target"), "t_us")
    picked = tagged.where("is_target").join(targets.select("event_id"), "event_id", "left_semi").select(keyed("event_id"))
    out = causal_events(own, picked, fanout=fanout, strategy=strategy, seed=seed)
    return out.select("target_id.window_id", F.col("target_id.id").alias("target_id"), "hop", F.col("account.id").alias("account"), F.col("event_id.id").alias("event_id"), "event_us")


def score_before_update(history: DataFrame | None, targets: DataFrame, *, key: str = "source", label: str = "label", prior: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """Events in time order as a stateful predictor meets them: targets with score, what its state says before the event's own time enters it; history only enters, its score is null.

    The state is each account's share of label 1 so far, (bad + prior[0]) / (all + prior[1]), events of one time entering
    together behind their scores. Accounts' times are counted in one order, so that a busy account is no single task.
    """
    rows = timestamp_groups(history, targets)
    moments = rows.groupBy(F.col(key).alias("__a"), F.col("t_us").alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__bad"))
    upto = running_sums(moments, [F.col("__a"), F.col("__t")], {"__cn": F.col("__n"), "__cb": F.col("__bad")})
    upto = upto.withColumns({"__cn": F.col("__cn") - F.col("__n"), "__cb": F.col("__cb") - F.col("__bad")})
    first = upto.groupBy("__a").agg(F.min("__cn").alias("__fn"), F.min("__cb").alias("__fb"))
    seen = upto.join(first, "__a").select(F.col("__a").alias(key), F.col("__t").alias("t_us"), (F.col("__cn") - F.col("__fn")).alias("seen"), (F.col("__cb") - F.col("__fb")).alias("seen_bad"))
    score = (F.col("seen_bad") + F.lit(prior[0])) / (F.col("seen") + F.lit(prior[1]))
    return rows.join(seen, [key, "t_us"]).withColumn("score", F.when(F.col("target_event_mask"), score))


def recent_neighbors(events: DataFrame, *, size: int, until: Column | None = None) -> DataFrame:
    """account, neighbor, event_id, event_us, rank: the last size interactions of each account in either direction."""
    if size < 1:
        raise ValueError("size is 1 or more")
    rows = events if until is None else events.where(until)
    out = rows.select(F.col("source").alias("account"), F.col("target").alias("neighbor"), "event_id", F.col("t_us").alias("event_us"))
    both = out.unionByName(rows.select(F.col("target").alias("account"), F.col("source").alias("neighbor"), "event_id", F.col("t_us").alias("event_us")))
    w = W.partitionBy("account").orderBy(F.desc("event_us"), F.desc("event_id"), F.desc("neighbor"))
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= size)


def timestamp_groups(history: DataFrame | None, targets: DataFrame, *, validate: bool = True) -> DataFrame:
    """Events of history (target_event_mask false) and targets (true) with group_id, from 0 for each distinct time.

    history must end before targets start. The groups are numbered over distinct times, in ranges of time.
    """
    rows = targets.withColumn("target_event_mask", F.lit(True))
    if history is not None:
        if validate:
            end, start = history.agg(F.max("t_us")).first()[0], targets.agg(F.min("t_us")).first()[0]
            if end is not None and start is not None and end >= start:
                raise ValueError("history must end strictly before the targets start")
        rows = history.withColumn("target_event_mask", F.lit(False)).unionByName(rows)
    groups = with_row_index(rows.select("t_us").distinct(), [F.col("t_us")], "group_id")
    return rows.join(groups, "t_us")


def mean_messages(sampled: DataFrame, messages: DataFrame, *, value_col: str) -> DataFrame:
    """target_id, mean_message: the mean of log1p(abs(value)) over a target's sampled events."""
    value = F.log1p(F.abs(F.col(value_col).cast("double")))
    return sampled.select("target_id", "event_id").join(messages.select("event_id", value_col), "event_id").groupBy("target_id").agg(F.avg(value).alias("mean_message"))


def endpoint_means(events: DataFrame, *, value_col: str) -> DataFrame:
    """t_us, account, mean_value, n: the mean over the events of one time that touch an account, either end counting."""
    ends = [events.select("t_us", F.col(c).alias("account"), F.col(value_col).alias("v")) for c in ("source", "target")]
    return ends[0].unionByName(ends[1]).groupBy("t_us", "account").agg(F.avg("v").alias("mean_value"), F.count(F.lit(1)).alias("n"))
