"""Statistics of an account's edges as many rows see them, in numpy over Arrow.

Records come sorted by account (v) and bucket (__k): edges of both sides and asks. What an ask sees is a stretch of the account's edges in
the order of time. Tasks hold the edges and asks of some accounts at a time, of one account and bucket at least.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Records gathered before they are described, edges looked at in one step, and asks of one account and batch from which sums run along its edges instead.
CHUNK, STEP, MANY = 200_000, 1_000_000, 1024
#: Kinds of records.
OUT, IN, OF_SOURCE, OF_TARGET = range(4)
SIDES = (("out", OUT), ("in", IN))
#: Variances below it count as none.
NONE = 1e-12


def describer(names: list[tuple[str, int]], values: int, bounded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow. names: the statistics and the number of the value column each is of. bounded: records have place, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, CHUNK
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_starts(table))[-1])
            if cut:
                yield from _described(table.slice(0, cut), names, values, bounded)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
            enough = max(CHUNK, 2 * rows)
        if rows:
            yield from _described(pa.Table.from_batches(held).combine_chunks(), names, values, bounded)

    return run


def _starts(table: pa.Table) -> np.ndarray:
    """Where another account or bucket begins."""
    new = np.ones(table.num_rows, bool)
    v, k = table["v"].combine_chunks(), table["__k"].to_numpy()
    new[1:] = pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False) | (k[1:] != k[:-1])
    return new


def _described(table: pa.Table, names: list[tuple[str, int]], values: int, bounded: bool) -> Iterator[pa.RecordBatch]:
    group, kind = np.cumsum(_starts(table)) - 1, table["kind"].to_numpy()
    asks = np.flatnonzero(kind >= OF_SOURCE)
    if not len(asks):
        return
    any_, columns = np.zeros(len(asks), bool), {}
    for side, of in SIDES:
        found = _side(table, group, np.flatnonzero(kind == of), asks, names, values, bounded)
        any_ |= found[0]
        columns |= {f"{side}_{k}": c for k, c in enumerate(found[1])}
    seq, target = table["seq"].to_numpy()[asks], kind[asks] == OF_TARGET
    made = {"seq": seq[any_].astype("int64"), "target": target[any_]} | {n: c[any_] for n, c in columns.items()}
    yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in made.items()})


def _side(table: pa.Table, group: np.ndarray, edges: np.ndarray, asks: np.ndarray, names: list[tuple[str, int]], values: int, bounded: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    out = [np.zeros(len(asks), "int64" if n in ("fan", "degree") else "float64") for n, _ in names]
    time, batch, floor = (table[c].to_numpy() for c in ("et", "b", "floor"))
    times, rank = np.unique(np.concatenate([time[edges], time[asks], floor[asks]]), return_inverse=True)
    at, low, least = np.split(rank, [len(edges), len(edges) + len(asks)])
    key, mine = group[edges] * (len(times) + 1) + at, group[asks] * (len(times) + 1)
    order = np.argsort(key, kind="stable")
    edges, key = edges[order], key[order]
    lo = np.maximum(np.searchsorted(key, mine + low, "left"), np.searchsorted(key, mine + least, "right"))
    # behind hi are only edges of later batches
    of = np.unique(np.concatenate([batch[edges], batch[asks]]), return_inverse=True)[1]
    entered, asking = of[: len(edges)], of[len(edges) :]
    most = len(of) + 1
    comes, seen = group[edges] * most + entered, group[asks] * most + asking
    hi = np.searchsorted(np.minimum.accumulate(comes[::-1])[::-1], seen, "right")
    place = table["place"].to_numpy() if bounded else None
    mixed = bounded or bool((comes[1:] < comes[:-1]).any())

    def visible(idx: np.ndarray, ask: np.ndarray) -> np.ndarray:
        good = entered[idx] <= asking[ask]
        return good & (place[edges[idx]] > place[asks[ask]]) if bounded else good

    code = pc.dictionary_encode(table["nbr"].combine_chunks().take(pa.array(edges))).indices.to_numpy(zero_copy_only=False).astype("int64") if len(edges) else np.zeros(0, "int64")
    same = np.lexsort((code, group[edges]))
    ahead = np.full(len(edges), -1)
    alike = (code[same[1:]] == code[same[:-1]]) & (group[edges[same[1:]]] == group[edges[same[:-1]]])
    ahead[same[1:][alike]] = same[:-1][alike]
    xs = []
    for k in range(values):
        column = table[f"x{k}"].combine_chunks().take(pa.array(edges))
        xs.append((np.asarray(column.fill_null(0.0)), ~np.asarray(column.is_null())))
        xs[-1] += (np.argsort(np.argsort(xs[-1][0], kind="stable"), kind="stable"), np.sort(xs[-1][0]))

    def put(ask: np.ndarray, fan: np.ndarray, n: np.ndarray) -> None:
        for k, (name, _) in enumerate(names):
            if name in ("fan", "degree", "ratio"):
                out[k][ask] = {"fan": fan, "degree": n, "ratio": n / fan}[name]

    full = np.flatnonzero(hi > lo)
    pairs, at, often = np.unique(seen[full], return_inverse=True, return_counts=True)
    for pair in np.flatnonzero(often > MANY):
        ask = full[at == pair]
        idx = np.arange(lo[ask].min(), hi[ask[0]])
        idx = idx[visible(idx, np.full(len(idx), ask[0]))] if mixed else idx
        n = len(idx) - np.searchsorted(idx, lo[ask])
        ask, n, back = ask[n > 0], n[n > 0], idx[::-1]
        first = np.zeros(len(back), "int64")
        first[np.unique(code[back], return_index=True)[1]] = 1
        if len(ask):
            put(ask, np.cumsum(first)[n - 1], n)
        for k, (x, good, _, _) in enumerate(xs):
            has = np.cumsum(good[back])[n - 1] if len(ask) else n
            _put_values(out, names, k, ask[has > 0], _running(x[back[good[back]]], has[has > 0]))
    few = full[(often <= MANY)[at]] if len(full) else full
    ends = np.cumsum((hi - lo)[few])
    begin = 0
    while begin < len(few):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + STEP, "right")))
        ask = few[begin:stop]
        begin = stop
        n = hi[ask] - lo[ask]
        of = np.repeat(np.arange(len(ask)), n)
        idx = np.arange(len(of)) + np.repeat(lo[ask] - (np.cumsum(n) - n), n)
        if mixed:
            good = visible(idx, ask[of])
            idx, of = idx[good], of[good]
            n = np.bincount(of, minlength=len(ask))
            each = np.unique(of * (len(code) + 1) + code[idx]) // (len(code) + 1)
            fan = np.bincount(each, minlength=len(ask))
        else:
            fan = np.bincount(of[ahead[idx] < lo[ask][of]], minlength=len(ask))
        put(ask[n > 0], fan[n > 0], n[n > 0])
        for k, (x, good, rank, ranked) in enumerate(xs):
            i, o, has = idx, of, n
            if not good.all():
                i, o = idx[good[idx]], of[good[idx]]
                has = np.bincount(o, minlength=len(ask))
            if len(i):
                _put_values(out, names, k, ask[has > 0], _stretches(x[i], rank[i], ranked, o, has[has > 0]))
    degree = hi > lo
    if mixed:
        degree &= np.logical_or.reduce([c != 0 for c in out]) if out else degree
    return degree, out


def _put_values(out: list[np.ndarray], names: list[tuple[str, int]], of: int, ask: np.ndarray, made: dict[str, np.ndarray]) -> None:
    for k, (name, value) in enumerate(names):
        if value == of and name in made:
            out[k][ask] = made[name]


def _shape(m2: np.ndarray, m3: np.ndarray, m4: np.ndarray) -> dict[str, np.ndarray]:
    flat = m2 < NONE
    safe = np.where(flat, 1.0, m2)
    return {"var": m2, "skew": np.where(flat, 0.0, m3 / safe**1.5), "kurtosis": np.where(flat, 0.0, m4 / safe**2)}


def _stretches(x: np.ndarray, rank: np.ndarray, ranked: np.ndarray, of: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of stretches of n values that lie one behind another."""
    at = np.cumsum(n) - n
    total = np.add.reduceat(x, at)
    mean = total / n
    d = x - np.repeat(mean, n)
    d2 = d * d
    m2, m3, m4 = (np.add.reduceat(p, at) / n for p in (d2, d2 * d, d2 * d2))
    by = np.sort(of * len(ranked) + rank) % len(ranked)
    median = (ranked[by[at + (n - 1) // 2]] + ranked[by[at + n // 2]]) / 2
    return {"mean": mean, "sum": total, "min": np.fmin.reduceat(x, at), "max": np.maximum.reduceat(x, at), "median": median} | _shape(m2, m3, m4)


def _running(x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of the first n values, for each of n."""
    if not len(n):
        return {}
    middle = x.mean()
    d, last = x - middle, n - 1
    s1, s2, s3, s4 = (np.cumsum(d**p)[last] / n for p in (1, 2, 3, 4))
    m2 = np.maximum(s2 - s1**2, 0)
    m3, m4 = s3 - 3 * s1 * s2 + 2 * s1**3, s4 - 4 * s1 * s3 + 6 * s1**2 * s2 - 3 * s1**4
    ordered, medians, wanted = [], {}, set(n.tolist())
    for k, v in enumerate(x.tolist(), 1):
        insort(ordered, v)
        if k in wanted:
            medians[k] = (ordered[(k - 1) // 2] + ordered[k // 2]) / 2
    total = np.cumsum(x)[last]
    return {"mean": middle + s1, "sum": total, "min": np.fmin.accumulate(x)[last], "max": np.maximum.accumulate(x)[last], "median": np.array([medians[k] for k in n.tolist()])} | _shape(m2, m3, m4)
