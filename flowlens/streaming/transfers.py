"""Streams of transfers (transaction_id, source, target, timestamp, amount).

Where the batch operators keep every late row, streams drop what comes after the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_flows(stream: DataFrame, *, window: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Per window and account: transfers and amounts out and in, accounts paid. Tumbling, or sliding with slide."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("account"), F.lit("out").alias("side")), F.struct(F.col("target").alias("account"), F.lit("in").alias("side"))))
    rows = stream.withWatermark("timestamp", watermark).withColumn("__e", ends).select("timestamp", "amount", "__e.account", "__e.side")
    spans = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out, in_ = F.col("side") == "out", F.col("side") == "in"
    flows = rows.groupBy(spans.alias("w"), "account").agg(F.count_if(out).alias("n_out"), F.count_if(in_).alias("n_in"), F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0.0)).alias("amount_out"), F.coalesce(F.sum(F.when(in_, F.col("amount"))), F.lit(0.0)).alias("amount_in"))
    return flows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "account", "n_out", "n_in", "amount_out", "amount_in")


def ordered_or_late(batch: DataFrame, last_us: int | None) -> DataFrame:
    """Rows of a micro-batch that lie before the last time of the batch ahead: what an order guard reports."""
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return batch.where(t < F.lit(last_us)) if last_us is not None else batch.where(F.lit(False))


def rolling_counts(times: np.ndarray, targets: np.ndarray, amounts: np.ndarray, retention: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different targets, rows, amount) of the rows up to each one, itself included, that are less than retention older and, with most > 0, among the last so many. times rise."""
    n = len(times)
    at = np.arange(n)
    first = np.searchsorted(times, times - retention, "right")
    gone = np.searchsorted(times, times + retention, "left")  # the first row that a row is too old for
    if most > 0:
        first, gone = np.maximum(first, at + 1 - most), np.minimum(gone, at + most)
    total = np.concatenate([[0.0], np.cumsum(amounts)])
    # a target counts from a row until that row is gone or the target comes again
    order = np.lexsort((at, np.unique(targets, return_inverse=True)[1]))
    code = targets[order]
    later = np.full(n, n + 1)
    same = code[1:] == code[:-1]
    later[order[:-1][same]] = order[1:][same]
    ahead = np.full(n, -1)
    ahead[order[1:][same]] = order[:-1][same]
    change = np.zeros(n + 1, np.int64)
    fresh = (ahead < 0) | (gone[ahead] <= at)
    np.add.at(change, at[fresh], 1)
    ends = later >= gone
    np.add.at(change, np.minimum(gone[ends], n), -1)
    return np.cumsum(change[:n]), at - first + 1, total[1:] - total[first]


def rolling_account_state(stream: DataFrame, *, retention_us: int, max_edges: int = -1, watermark: str = "1 hour") -> DataFrame:
    """For each transfer, what its source has sent within the retention before it: fan_out, degree_out, amount_out (itself included).

    State is per account: what the retention holds, or with max_edges at most so many transfers, the oldest leaving
    first (-1 for no bound); it expires with event time. A batch's transfers are counted all at once.
    """
    if retention_us <= 0 or max_edges == 0 or max_edges < -1:
        raise ValueError("retention is positive, max_edges -1 or positive")
    out = "transaction_id string, source string, t_us long, fan_out long, degree_out long, amount_out double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else ([], [], [])
        rows = pd.concat(list(frames)).sort_values(["t_us", "transaction_id"])
        times = np.concatenate([np.array(kept[0], np.int64), rows["t_us"].to_numpy(np.int64)])
        targets = np.concatenate([np.array(kept[1], object), rows["target"].astype(str).to_numpy(object)]).astype(str)
        amounts = np.concatenate([np.array(kept[2], float), rows["amount"].to_numpy(float)])
        new = np.arange(len(times)) >= len(kept[0])
        order = np.argsort(times, kind="stable")  # rows that come late take their place
        times, targets, amounts, new = times[order], targets[order], amounts[order], new[order]
        fan, degree, amount = rolling_counts(times, targets, amounts, retention_us, max_edges)
        stay = times > times[-1] - retention_us
        if max_edges > 0:
            stay[:-max_edges] = False
        state.update((times[stay].tolist(), targets[stay].tolist(), amounts[stay].tolist()))
        at = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(at + 1, int(times[-1]) // 1000 + retention_us // 1000 + 1))
        yield pd.DataFrame({"transaction_id": rows["transaction_id"].to_numpy(), "source": key[0], "t_us": times[new], "fan_out": fan[new], "degree_out": degree[new], "amount_out": amount[new]})

    rows = stream.withWatermark("timestamp", watermark).withColumn("t_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    return rows.groupBy("source").applyInPandasWithState(step, out, "times array<long>, targets array<string>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def recent_neighbors_stream(stream: DataFrame, *, size: int, watermark: str = "1 hour") -> DataFrame:
    """For each end of each transfer, the accounts it met in its last size transfers before (newest first); then the transfer is inserted."""
    if size < 1:
        raise ValueError("size is 1 or more")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0])[::-1] if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t_us", "transaction_id"])
        every = seen + rows["neighbor"].astype(str).tolist()
        t = rows["t_us"].to_numpy()
        starts = len(seen) + np.searchsorted(t, t, "left")  # transfers of one time do not see each other
        recent = [every[max(0, s - size) : s][::-1] for s in starts.tolist()]
        state.update((every[-size:][::-1],))
        yield pd.DataFrame({"transaction_id": rows["transaction_id"].to_numpy(), "account": key[0], "recent": recent})

    ends = F.explode(F.array(F.struct(F.col("source").alias("account"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("account"), F.col("source").alias("neighbor"))))
    rows = stream.withWatermark("timestamp", watermark).withColumn("t_us", F.unix_micros(F.col("timestamp").cast("timestamp"))).withColumn("__e", ends)
    rows = rows.select("transaction_id", "t_us", "timestamp", "__e.account", "__e.neighbor")
    return rows.groupBy("account").applyInPandasWithState(step, "transaction_id string, account string, recent array<string>", "recent array<string>", "append", GroupStateTimeout.NoTimeout)
