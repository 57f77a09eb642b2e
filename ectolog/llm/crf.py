"""A linear-chain conditional random field of two labels over coded lines.

A line is a row of codes, one for each measure; a code has a weight for each
label. Chains of a sample are padded to one length, so that a step of the
forward-backward recursions serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOILERPLATE, CONTENT = 0, 1
STEPS = 60
RATE = 0.2
PENALTY = 1e-3


@dataclass
class Field:
    """Weights: ``codes`` (codes, 2), ``turns`` (2, 2) from label to label, ``start`` (2)."""

    codes: np.ndarray
    turns: np.ndarray
    start: np.ndarray

    @classmethod
    def flat(cls, n_codes: int) -> Field:
        """Everything is content."""
        return cls(np.zeros((n_codes, 2)), np.zeros((2, 2)), np.array([-1.0, 1.0]))

    def packed(self) -> np.ndarray:
        return np.concatenate([self.codes.ravel(), self.turns.ravel(), self.start])

    @classmethod
    def unpacked(cls, data: np.ndarray) -> Field:
        return cls(data[:-6].reshape(-1, 2).copy(), data[-6:-2].reshape(2, 2).copy(), data[-2:].copy())

    def scores(self, lines: np.ndarray) -> np.ndarray:
        return self.codes[lines].sum(axis=1)


def viterbi(scores: np.ndarray, turns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels of one chain; of equally good ones those that end and stay in content."""
    n = len(scores)
    if n == 0:
        return np.zeros(0, np.int8)
    (aa, ab), (ba, bb) = turns.tolist()
    a, b = (scores[0] + start).tolist()
    from_a, from_b = bytearray(n), bytearray(n)
    for t, (sa, sb) in enumerate(scores[1:].tolist(), 1):
        via_a, via_b = (a + aa, a + ab), (b + ba, b + bb)
        from_a[t], from_b[t] = via_b[0] >= via_a[0], via_b[1] >= via_a[1]
        a, b = (via_b if from_a[t] else via_a)[0] + sa, (via_b if from_b[t] else via_a)[1] + sb
    labels = bytearray(n)
    label = int(b >= a)
    for t in range(n - 1, -1, -1):
        labels[t] = label
        label = from_b[t] if label else from_a[t]
    return np.frombuffer(bytes(labels), np.int8)


class Chains:
    """Chains side by side, the longest first: at step t, the first ``live[t]`` of them go on."""

    def __init__(self, chains: list[np.ndarray]):
        self.order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        self.sizes = np.array([len(chains[i]) for i in self.order])
        self.n, self.most = len(chains), int(self.sizes[0])
        self.lines = np.concatenate([chains[i] for i in self.order])
        self.marked: np.ndarray | None = None
        # Place of each line in a table of (step, chain).
        chain = np.repeat(np.arange(self.n), self.sizes)
        step = np.concatenate([np.arange(s) for s in self.sizes])
        self.at = (step, chain)
        self.live = np.array([(self.sizes > t).sum() for t in range(self.most)])

    def has_code(self, n_codes: int) -> np.ndarray:
        """A row for each line with ones at its codes."""
        if self.marked is None:
            self.marked = np.zeros((len(self.lines), n_codes), np.float32)
            self.marked[np.arange(len(self.lines))[:, None], self.lines] = 1
        return self.marked

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.most, self.n, *values.shape[1:]), values.dtype)
        out[self.at] = values
        return out

    def marginals(self, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines (lines, 2), of the turns summed (2, 2), of the first lines summed (2)."""
        s = self.spread(self.has_code(len(field.codes)) @ field.codes.astype(np.float32)).astype(float)
        t = np.exp(field.turns - field.turns.max())
        s = np.exp(s - s.max(axis=2, keepdims=True))
        first = s[0] * np.exp(field.start - field.start.max())
        ahead = np.zeros_like(s)
        ahead[0] = first / first.sum(axis=1, keepdims=True)
        for k in range(1, self.most):
            n = self.live[k]
            v = (ahead[k - 1, :n] @ t) * s[k, :n]
            ahead[k, :n] = v / v.sum(axis=1, keepdims=True)
        behind = np.ones_like(s)
        turns = np.zeros((2, 2))
        for k in range(self.most - 1, 0, -1):
            n = self.live[k]
            v = s[k, :n] * behind[k, :n]
            pair = ahead[k - 1, :n, :, None] * t[None] * v[:, None, :]
            turns += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            v = v @ t.T
            behind[k - 1, :n] = v / v.sum(axis=1, keepdims=True)
        p = ahead * behind
        p /= np.maximum(p.sum(axis=2, keepdims=True), np.finfo(float).tiny)
        return p[self.at], turns, p[0].sum(axis=0)

    def turns_of(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.spread(labels)
        turns = np.zeros((2, 2))
        for k in range(1, self.most):
            n = self.live[k]
            turns += np.bincount(2 * table[k - 1, :n] + table[k, :n], minlength=4).reshape(2, 2)
        return turns, np.bincount(table[0], minlength=2).astype(float)


def gradient(field: Field, chains: Chains, labels: np.ndarray) -> np.ndarray:
    """Of the mean log-likelihood of the labels by line, with the penalty."""
    p, turns, start = chains.marginals(field)
    seen_turns, seen_start = chains.turns_of(labels)
    off = np.eye(2)[labels] - p
    codes = (chains.has_code(len(field.codes)).T @ off.astype(np.float32)).astype(float)
    found = Field(codes, seen_turns - turns, seen_start - start).packed() / len(chains.lines)
    return found - PENALTY * field.packed()


def fit(field: Field, chains: Chains, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Gradient ascent with moments (Adam), the same for every run."""
    x, mean, square = field.packed(), 0.0, 0.0
    for k in range(1, steps + 1):
        g = gradient(Field.unpacked(x), chains, labels)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        x = x + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return Field.unpacked(x)
