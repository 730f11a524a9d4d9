"""A linear-chain conditional random field in numpy, trained by batched forward-backward."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Field:
    """Weights: of features (by name, a row per feature), of label pairs, of first labels."""

    index: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray
    first: np.ndarray

    def emission(self, names: list[str]) -> np.ndarray:
        rows = [self.index[n] for n in names if n in self.index]
        return self.weight[rows].sum(0) if rows else np.zeros(self.weight.shape[1])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sentences: list[list[list[str]]], labels: list[list[int]], n_labels: int, *, steps: int = 110, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximise the likelihood of the labels with Adam; sentences are lists of tokens, tokens lists of feature names."""
    names = sorted({f for s in sentences for t in s for f in t})
    index = {f: k for k, f in enumerate(names)}
    b, t = len(sentences), max(map(len, sentences))
    wide = max(len(token) for s in sentences for token in s)
    x, gold, live = np.full((b, t, wide), len(names)), np.zeros((b, t), int), np.zeros((b, t), bool)  # row len(names) stays zero
    for i, (s, y) in enumerate(zip(sentences, labels)):
        for j, token in enumerate(s):
            x[i, j, : len(token)] = [index[f] for f in token]
        gold[i, : len(y)], live[i, : len(y)] = y, True
    onehot = np.eye(n_labels)[gold] * live[..., None]
    used = x[live]
    pairs_live = live[:, 1:, None, None]
    gold_pairs = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1))
    params = [np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, pair, first = params
        e = np.zeros((b, t, n_labels))
        e[live] = np.vstack([w, np.zeros(n_labels)])[used].sum(1)
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = first + e[:, 0]
        for j in range(1, t):
            now = _lse(ahead[:, j - 1, :, None] + pair, 1) + e[:, j]
            ahead[:, j] = np.where(live[:, j, None], now, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            now = _lse(pair + (e[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where(live[:, j + 1, None], now, 0)
        z = _lse(ahead[:, -1], 1)
        node = np.exp(ahead + back - z[:, None, None]) * live[..., None]
        both = np.exp(np.where(pairs_live, ahead[:, :-1, :, None] + pair + (e + back)[:, 1:, None, :] - z[:, None, None, None], -np.inf)).sum((0, 1))
        off = (onehot - node)[live]
        by_feature = [np.bincount(used.ravel(), np.repeat(off[:, k], wide), len(names) + 1)[:-1] for k in range(n_labels)]
        slopes = [np.stack(by_feature, 1), gold_pairs - both, (onehot[:, 0] - node[:, 0]).sum(0)]
        for k, g in enumerate(slopes):
            g = g / b - decay * params[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(index, *params)
