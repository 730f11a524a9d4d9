"""Reference semantics in plain Python, written from the definitions, for small tables."""

from __future__ import annotations

from datetime import datetime, timedelta


def at(text: str) -> datetime:
    """A time of 2025-01-01, or of the given day of January."""
    day, _, clock = text.rpartition(" ")
    hour, minute = (int(x) for x in clock.split(":"))
    return datetime(2025, 1, int(day or 1), hour, minute)


def day(k: int) -> datetime:
    return datetime(2025, 1, 1) + timedelta(days=k - 1)


def us(when: datetime) -> int:
    return (when - datetime(1970, 1, 1)) // timedelta(microseconds=1)


class Graph:
    """A multigraph with retention: rows are inserted in batches, then described."""

    def __init__(self, keep: int, most: int = -1) -> None:
        self.keep, self.most, self.edges = keep, most, []

    def insert(self, batch: list[tuple]) -> None:
        for e in batch:  # (id, u, v, t, value, batch)
            if any(x[0] == e[0] for x in self.edges):
                continue
            self.edges.append(e)
            self.edges = [x for x in self.edges if x[3] > e[3] - self.keep]
            if self.most > 0:
                self.edges = self.edges[-self.most :]

    def histogram(self, row: tuple, kind: str, side: str, tw: int, bins: tuple) -> list[int]:
        mine, other = (2, 1) if side == "in" else (1, 2)
        near = [e for e in self.edges if e[mine] == row[mine]]
        out = [0] * len(bins)
        if all(e[0] != row[0] for e in near):
            return out
        for e in near:
            if e[5] != row[5] or not 0 <= e[3] - row[3] < tw:
                continue
            within = [x[other] for x in near if e[3] - tw < x[3] <= e[3]]
            n = len(set(within)) if kind == "fan" else len(within)
            k = max((k for k, b in enumerate(bins) if n >= b), default=-1)
            if k >= 0:
                out[k] += 1
        return out

    def _window(self, tw: int) -> set[tuple]:
        latest = max(e[3] for e in self.edges)
        return {e for e in self.edges if e[3] >= latest - tw}

    def scatter_gather(self, row: tuple, tw: int, bins: tuple) -> list[int]:
        pairs = {(e[1], e[2]) for e in self._window(tw)}
        out_of = lambda x: {b for a, b in pairs if a == x}
        into = lambda x: {a for a, b in pairs if b == x}
        _, u, v = row[:3]
        sizes = [len(out_of(u) & into(w)) for w in out_of(v) - {u}] + [len(into(v) & out_of(o)) for o in into(u) - {v}]
        return [sum(1 for n in sizes if n >= max(b, 2) and (k + 1 == len(bins) or n < bins[k + 1])) for k, b in enumerate(bins)]

    def cycles(self, row: tuple, tw: int, bins: tuple, longest: int, timed: bool) -> list[int]:
        edges = self._window(tw)
        found = set()

        def walk(path: tuple, prev: int, downs: int) -> None:
            for e in edges:
                if e[1] != path[-1]:
                    continue
                d = downs + (e[3] <= prev) if timed else 0
                if timed and d > 1:
                    continue
                if e[2] == path[0] and len(path) >= 2:
                    if not timed or d + (row[3] <= e[3]) == 1:
                        found.add(path)
                elif e[2] not in path and len(path) < longest:
                    walk((*path, e[2]), e[3], d)

        if row[1] != row[2]:
            walk((row[1], row[2]), row[3], 0)
        sizes = [len(p) for p in found]
        return [sum(1 for n in sizes if n >= b and (k + 1 == len(bins) or n < bins[k + 1])) for k, b in enumerate(bins)]

    def statistics(self, row: tuple, end: int, side: str, tw: int) -> list[float]:
        mine, other = (1, 2) if side == "out" else (2, 1)
        e = [x for x in self.edges if x[mine] == row[end] and x[3] >= row[3] - tw]
        if not e:
            return [0.0] * 11
        v = sorted(x[4] for x in e)
        n, mean = len(v), sum(v) / len(v)
        m = [sum((x - mean) ** k for x in v) / n for k in (2, 3, 4)]
        median = (v[(n - 1) // 2] + v[n // 2]) / 2
        fan = len({x[other] for x in e})
        return [fan, n, n / fan, mean, sum(v), v[0], v[-1], median, m[0], m[1] / m[0] ** 1.5 if m[0] > 1e-12 else 0.0, m[2] / m[0] ** 2 if m[0] > 1e-12 else 0.0]
