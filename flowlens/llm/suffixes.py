"""Two-stage suffix sorting of many short byte strings, and the windows that it shows to be repeated."""

from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each place but the last: is the suffix there smaller than the one that follows it?"""
    rise = np.diff(t.astype(np.int16))
    change = np.flatnonzero(rise)
    at = np.searchsorted(change, np.arange(len(rise)))
    return np.where(at < len(change), rise[change[np.minimum(at, max(0, len(change) - 1))]] > 0 if len(change) else False, False)


def two_stage_sort(data: bytes, wanted: np.ndarray, width: int) -> np.ndarray:
    """The places in wanted by the suffixes there; those equal over width bytes come in any order, together.

    data ends in width zero bytes behind the last wanted place. Only suffixes smaller than their
    successors are sorted directly, by their first width bytes. The others are induced: when the bucket
    of a first byte is complete, a scan of it in order puts each place before one of its entries, if its
    suffix is larger, at the end of that place's own bucket. So a larger suffix needs its successor
    sorted too: places behind wanted ones are added up to the next smaller one.
    """
    t = np.frombuffer(data, np.uint8)
    small = smaller_than_next(t)
    use = np.zeros(len(t), bool)
    use[wanted] = True
    ask = use.copy()
    # up to the next small place behind each wanted one
    stops = np.flatnonzero(small)
    tails = wanted[~small[wanted]]
    if len(tails):
        k = np.searchsorted(stops, tails)
        ends = np.where(k < len(stops), stops[np.minimum(k, max(0, len(stops) - 1))] if len(stops) else len(t) - 1, len(t) - 1)
        edge = np.zeros(len(t) + 1, np.int32)
        np.add.at(edge, tails, 1)
        np.add.at(edge, ends + 1, -1)
        use |= np.cumsum(edge[:-1]) > 0
    places = np.flatnonzero(use)
    last = len(t) - 1
    direct = places[places < last]
    direct = direct[small[direct]]
    keys = [data[p : p + width] for p in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    first = t[direct]
    by_byte = np.searchsorted(first, np.arange(257))
    larger = use.copy()
    larger[direct] = False
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if use[last]:  # the shortest suffix is the smallest of its bucket
        induced[t[last]].append(np.array([last]))
    out = []
    for c in range(256):
        head = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        scan = head
        parts = []
        while len(scan):  # runs of c grow by one a round; a longer run is a larger suffix
            parts.append(scan)
            before = scan[scan > 0] - 1
            before = before[larger[before]]
            _share(before[t[before] != c], t, induced)
            scan = before[t[before] == c]
        tail = direct[by_byte[c] : by_byte[c + 1]]
        parts.append(tail)
        before = tail[tail > 0] - 1
        _share(before[larger[before]], t, induced)
        out += parts
    order = np.concatenate(out)
    return order[ask[order]]


def _share(places: np.ndarray, t: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    if len(places):
        own = t[places]
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for part in np.split(places[order], cuts):
            buckets[t[part[0]]].append(part)


def common_prefixes(data: bytes, order: np.ndarray, width: int) -> np.ndarray:
    """How many bytes, up to width, each place of order has in common with the one behind it; data ends in width + 8 bytes more."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # eight bytes from every place on
    out = np.full(max(0, len(order) - 1), width, np.int64)
    live = np.arange(len(out))
    a, b = order[:-1], order[1:]
    for step in range(0, width, 8):
        differ = words[a + step] ^ words[b + step]
        end = np.flatnonzero(differ)
        if len(end):
            low = differ[end] & (~differ[end] + np.uint64(1))  # the lowest bit that differs lies in the first such byte
            out[live[end]] = np.minimum(width, step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
            same = differ == 0
            live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
    return out


def repeated_windows(strings: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """For each string, which of its windows (places of width bytes) occur twice or more; a string with a count over 1 stands for copies."""
    lengths = np.array([len(s) for s in strings])
    n = lengths - width + 1
    starts = np.cumsum(lengths) - lengths
    data = b"".join(strings) + bytes(width + 8)
    total = int(n.sum())
    offset = np.cumsum(n) - n
    wanted = np.repeat(starts - offset, n) + np.arange(total)
    sa = two_stage_sort(data, wanted, width)
    same = common_prefixes(data, sa, width) >= width
    flag = np.zeros(len(data), bool)
    flag[sa[:-1][same]] = True
    flag[sa[1:][same]] = True
    hit = flag[wanted] | np.repeat(np.array(counts) > 1, n)
    return np.split(hit, offset[1:])
