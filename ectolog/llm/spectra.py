"""Running spectra: eigenpairs of a centred scatter matrix under rank-one updates.

A batch of independent spectra is updated at once. Each update adds the outer
product of a vector: the vector is split into its part in the span and the rest,
negligible entries and equal eigenvalues are deflated, the roots of the secular
equation are bracketed between the poles that are left, and the eigenvectors
follow from entries recomputed out of the roots (Gu and Eisenstat), which keeps
them orthogonal. At most ``rank`` leading pairs are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Relative size below which an entry or a gap between eigenvalues is deflated.
TINY = 8 * np.finfo(float).eps
MOST_STEPS = 60


@dataclass
class Spectra:
    """``n`` (K), ``mean`` (K, d), ascending ``values`` (K, r), ``vectors`` (K, d, r) of K scatters."""

    n: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, k: int, d: int) -> Spectra:
        return cls(np.zeros(k), np.zeros((k, d)), np.zeros((k, 0)), np.zeros((k, d, 0)))

    def add(self, x: np.ndarray, here: np.ndarray, rank: int) -> None:
        """One vector to each spectrum of which ``here`` is true, by a centred update."""
        off = np.where(here[:, None], x - self.mean, 0.0)
        grown = self.n + here
        self.update(off * np.sqrt(self.n / np.maximum(grown, 1))[:, None], rank)
        self.mean += off / np.maximum(grown, 1)[:, None]
        self.n = grown

    def merge(self, other: Spectra, rank: int) -> None:
        """The spectra of both: one update for each pair of the other, one for the distance of the means."""
        for j in range(other.values.shape[1]):
            self.update(np.sqrt(other.values[:, j])[:, None] * other.vectors[:, :, j], rank)
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        off = other.mean - self.mean
        self.update(off * np.sqrt(self.n * share)[:, None], rank)
        self.mean = self.mean + off * share[:, None]
        self.n = n

    def update(self, v: np.ndarray, rank: int) -> None:
        """Adds the outer product of each row of ``v`` (K, d)."""
        if self.values.shape[1] < v.shape[1]:
            self._span(v)
        z = np.einsum("kdr,kd->kr", self.vectors, v)
        turned, values = _rotated(self.values, z, self.vectors)
        self.values, self.vectors = values, turned
        drop = max(0, values.shape[1] - rank)
        if drop:
            self.values, self.vectors = self.values[:, drop:], np.ascontiguousarray(self.vectors[:, :, drop:])

    def _span(self, v: np.ndarray) -> None:
        """One more direction, of eigenvalue 0: the rest of ``v``, or any other where there is none."""
        rest = _outside(self.vectors, v)
        size = np.linalg.norm(rest, axis=1)
        none = size <= 1e-9 * np.maximum(np.linalg.norm(v, axis=1), np.finfo(float).tiny)
        if none.any():
            least = np.argmin((self.vectors[none] ** 2).sum(axis=2), axis=1)
            rest[none] = _outside(self.vectors[none], np.eye(v.shape[1])[least])
            size = np.linalg.norm(rest, axis=1)
        unit = rest / size[:, None]
        unit = _outside(self.vectors, unit)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        self.vectors = np.concatenate([unit[:, :, None], self.vectors], axis=2)
        self.values = np.concatenate([np.zeros((len(v), 1)), self.values], axis=1)


def _outside(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    return v - np.einsum("kdr,kr->kd", basis, np.einsum("kdr,kd->kr", basis, v))


def _rotated(values: np.ndarray, z: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and ascending eigenvalues of vectors (values + z z^T) vectors^T."""
    z, vectors = z.copy(), vectors.copy()
    rho = np.einsum("kr,kr->k", z, z)
    scale = np.maximum(values[:, -1], rho)
    tiny = TINY * scale
    # Equal eigenvalues: a rotation moves both entries into the later one.
    for j in np.flatnonzero((np.diff(values, axis=1) <= tiny[:, None]).any(axis=0)):
        both = (values[:, j + 1] - values[:, j] <= tiny) & (z[:, j] != 0)
        if not both.any():
            continue
        a, b = z[both, j], z[both, j + 1]
        size = np.hypot(a, b)
        c, s = b / size, a / size
        p, q = vectors[both, :, j], vectors[both, :, j + 1]
        vectors[both, :, j] = c[:, None] * p - s[:, None] * q
        vectors[both, :, j + 1] = s[:, None] * p + c[:, None] * q
        z[both, j], z[both, j + 1] = 0.0, size
    live = z * z > tiny[:, None] * np.finfo(float).eps
    live &= np.abs(z) * np.sqrt(rho)[:, None] > tiny[:, None]
    # Those that are left come first, ascending.
    order = np.argsort(~live, axis=1, kind="stable")
    poles = np.take_along_axis(values, order, axis=1)
    z2 = np.take_along_axis(np.where(live, z * z, 0.0), order, axis=1)
    sign = np.take_along_axis(np.where(z < 0, -1.0, 1.0), order, axis=1)
    live = np.take_along_axis(live, order, axis=1)
    roots, apart = _roots(poles, z2, live)
    turn = _turn(apart, z2, sign, live)
    roots = np.where(live, roots, poles)
    back = np.argsort(roots, axis=1, kind="stable")
    turn = np.take_along_axis(turn, back[:, None, :], axis=2)
    vectors = np.take_along_axis(vectors, order[:, None, :], axis=2)
    return vectors @ turn, np.maximum(np.take_along_axis(roots, back, axis=1), 0.0)


def _roots(poles: np.ndarray, z2: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (p_j - x), and (K, j, i): p_j minus the i-th root.

    The i-th root lies between the i-th and the next pole, the last one within
    the sum of z^2 behind its pole. It is sought as its distance from the nearer
    of the two, so that it is exact even beside a pole.
    """
    r = poles.shape[1]
    n = live.sum(axis=1)
    last = np.arange(r)[None, :] == (n - 1)[:, None]
    follow = np.concatenate([poles[:, 1:], poles[:, -1:]], axis=1)
    gap = np.where(last, z2.sum(axis=1)[:, None], follow - poles)
    gap = np.where(live, gap, 1.0)
    # Poles that are gone stand so far off that they add nothing.
    apart = np.where(live[:, :, None], poles[:, :, None] - poles[:, None, :], 1.0)
    weight = z2[:, :, None]
    upto = (np.arange(r)[:, None] <= np.arange(r)[None, :]).astype(float)
    over = 1.0 - upto
    sum_of = lambda a, side: np.einsum("kji,ji->ki", a, side)

    def values_at(x: np.ndarray, apart: np.ndarray):
        inverse = 1.0 / (apart - x[:, None, :])
        part = weight * inverse
        slope = part * inverse
        below, above = sum_of(part, upto), sum_of(part, over)
        return below, above, sum_of(slope, upto), sum_of(slope, over)

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        below, above, *_ = values_at(gap / 2, apart)
        right = (1 + below + above < 0) & live & ~last
        origin = np.where(right, gap, 0.0)
        apart = apart - np.where(live[:, :, None], origin[:, None, :], 0.0)
        lo = np.where(right, -gap / 2, 0.0)
        hi = np.where(right, 0.0, np.where(last, gap, gap / 2))
        # The exact distances of the two poles from the origin.
        near = np.where(right, -gap, 0.0)
        far = np.where(right, 0.0, gap)
        own = np.arange(r)
        apart[:, own, own] = np.where(live, near, 1.0)
        if r > 1:
            inner = live[:, 1:] & ~last[:, :-1]
            apart[:, own[1:], own[:-1]] = np.where(inner, far[:, :-1], apart[:, own[1:], own[:-1]])
        x = (lo + hi) / 2
        left = live.copy()
        for _ in range(MOST_STEPS):
            below, above, d_below, d_above = values_at(x, apart)
            f = 1 + below + above
            done = np.abs(f) <= 4 * np.finfo(float).eps * r * (1 + np.abs(below) + np.abs(above))
            left &= ~done & np.isfinite(f)
            if not left.any():
                break
            lo = np.where(left & (f < 0), x, lo)
            hi = np.where(left & (f > 0), x, hi)
            # Each side as one pole through its value and slope; the root of their sum is the next guess.
            a, b = near - x, far - x
            s, t = d_below * a * a, np.where(last, 0.0, d_above * b * b)
            c = 1 + (below - d_below * a) + np.where(last, 0.0, above - d_above * b)
            # c + s / (a - y) + t / (b - y) = 0 for the step y.
            p = c * (a + b) + s + t
            q = np.where(last, f * a, f * a * b)
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            y = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            y = np.where(last, a + s / c, y)
            step = x + y
            bad = ~(np.isfinite(step) & (step > lo) & (step < hi))
            step = np.where(bad, (lo + hi) / 2, step)
            left &= step != x
            x = np.where(left, step, x)
    apart = apart - x[:, None, :]
    return poles + origin + x, apart


def _turn(apart: np.ndarray, z2: np.ndarray, sign: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns, of the entries that have exactly the roots found.

    z_j^2 is the product of (root_i - p_j) over that of (p_i - p_j), i other than j;
    p_j - p_i is the difference of two distances from the same root.
    """
    own = np.arange(z2.shape[1])
    pairs = live[:, :, None] & live[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        apart = np.where(pairs, apart, 1.0)
        between = apart - apart[:, own, own][:, None, :]
        between[:, own, own] = -1.0
        factors = np.where(pairs, apart / between, 1.0)
        size = np.sqrt(np.abs(np.prod(factors, axis=2)))
        entry = np.where(live & np.isfinite(size), size, np.sqrt(z2)) * sign
        turn = np.where(pairs, entry[:, :, None] / apart, 0.0)
        turn /= np.maximum(np.linalg.norm(turn, axis=1), np.finfo(float).tiny)[:, None, :]
    turn[:, own, own] = np.where(live, turn[:, own, own], 1.0)
    return turn


def side_by_side(rows: int, rank: int, most: int = 64) -> int:
    """How many spectra to grow at once over so many rows: few enough that merging them is the lesser part."""
    k = 1
    while k < most and 4 * k * rank <= rows:
        k *= 2
    return k


def grow(found: Spectra, x: np.ndarray, rank: int) -> None:
    """The rows of ``x`` (n, d) dealt out over the spectra."""
    k = len(found.n)
    for at in range(0, len(x), k):
        part = x[at : at + k]
        here = np.arange(k) < len(part)
        if len(part) < k:
            part = np.concatenate([part, np.zeros((k - len(part), x.shape[1]))])
        found.add(part, here, rank)


def folded(found: Spectra, rank: int) -> Spectra:
    """All spectra of a batch (a power of two) merged into one, by halves."""
    while (half := len(found.n) // 2) > 0:
        parts = (found.n, found.mean, found.values, found.vectors)
        found = Spectra(*(p[:half] for p in parts))
        found.merge(Spectra(*(p[half:] for p in parts)), rank)
    return found
