"""Anchors: in every run of bytes of a fixed length, the place whose gram hashes lowest. Equal runs have equal anchors."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
_PLACE = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20_240_229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h = _TABLE[b]
    for k in range(5):  # 1, 2, 4, 8, 16 -> 32 bytes
        step = 1 << k
        h = h[:-step] * _MULT[k] + h[step:]
    h ^= h >> np.uint64(31)
    h *= _MULT[4]
    h ^= h >> np.uint64(29)
    return h


def runs(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor, over texts that lie in b at starts: (hash, context, text, at, n).

    hash: of the anchor's gram; context: of the bytes from the first window's start to the last one's end;
    text: which text; at: the first window's start within it; n: how many windows. b holds less than 16 MB.
    """
    long = lengths >= width
    if not long.any():
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    h = _gram_hashes(b)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, need = 1, width - GRAM + 1
    while span * 2 <= need:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < need:
        m = np.minimum(m[: len(m) - (need - span)], m[need - span :])
    place = (m & _PLACE).astype(np.int64)
    edge = np.zeros(len(b) + 1, np.int32)
    edge[starts[long]] += 1
    edge[starts[long] + lengths[long] - width + 1] -= 1
    valid = np.cumsum(edge[: len(place)]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    at = np.flatnonzero(first)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    n = np.flatnonzero(stop) + 1 - at
    text = np.searchsorted(starts, at, "right") - 1
    data = b.tobytes()
    context = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y], seed) for x, y in zip(at.tolist(), (at + n + width - 1).tolist())), np.uint64, len(at))
    return h[place[at]], context, text, at - starts[text], n
