"""A linear-chain conditional random field over categorical features, in numpy.

Each position has one value for each of ``F`` features, given as row numbers of
one weight table. Training maximises the regularised conditional likelihood of
a small labelled table by gradient steps (forward-backward over all sequences
at once); ``viterbi`` decodes many sequences at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray  # feature values x labels
    step: np.ndarray  # from label x to label
    first: np.ndarray  # labels

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.weights.shape[1]), np.float32)
        table = self.weights.astype(np.float32)
        for column in features.T:
            out += table[column]
        return out

    def decode(self, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return viterbi(self.emissions(features), starts, lengths, self.step.astype(np.float32), self.first.astype(np.float32))


def viterbi(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each position; sequence i holds the positions from ``starts[i]`` on. Ties: the lower label."""
    best = np.zeros(len(emit), np.int8)
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    if not len(starts):
        return best
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    score = emit[at] + first
    back = np.zeros(emit.shape, np.int8)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # sequences longer than t
    for t in range(1, n[0]):
        k = active[t]
        ways = score[:k, :, None] + step
        back[at[:k] + t] = ways.argmax(1)
        score[:k] = ways.max(1) + emit[at[:k] + t]
    best[at + n - 1] = score.argmax(1)
    for t in range(n[0] - 1, 0, -1):
        here = at[: active[t]] + t
        best[here - 1] = back[here, best[here]]
    return best


def train(features: list[np.ndarray], labels: list[np.ndarray], n_values: int, n_labels: int, rounds: int = 250, rate: float = 0.1, decay: float = 0.02) -> Chain:
    """Fits the chain. Deterministic: it starts at zero and takes ``rounds`` Adam steps over all sequences."""
    m, longest, width = len(features), max(map(len, features)), features[0].shape[1]
    x = np.zeros((m, longest, width), np.int64)
    y = np.zeros((m, longest), np.int64)
    there = np.zeros((m, longest), bool)
    for i, (f, own) in enumerate(zip(features, labels, strict=True)):
        x[i, : len(f)], y[i, : len(f)], there[i, : len(f)] = f, own, True
    params = [np.zeros((n_values, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    seen = [np.zeros_like(p) for p in params]
    np.add.at(seen[0], (x[there], y[there][:, None]), 1.0)
    both = there[:, 1:]
    np.add.at(seen[1], (y[:, :-1][both], y[:, 1:][both]), 1.0)
    np.add.at(seen[2], y[:, 0], 1.0)
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        w, step, first = params
        emit = w[x].sum(2)
        alpha, beta = np.zeros(emit.shape), np.zeros(emit.shape)
        alpha[:, 0] = emit[:, 0] + first
        for t in range(1, longest):
            alpha[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emit[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * there[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + step + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        at = x.reshape(-1)
        values = np.stack([np.bincount(at, np.repeat(node[:, :, k].ravel(), width), minlength=n_values) for k in range(n_labels)], axis=1)
        expected = [values, pair.sum((0, 1)), node[:, 0].sum(0)]
        for i, p in enumerate(params):
            g = seen[i] - expected[i] - decay * p
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            p += rate * (mean[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-8)
    return Chain(*params)
