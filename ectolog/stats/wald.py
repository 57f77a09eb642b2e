"""Test of a smooth term: a Wald statistic limited to the rank that the penalty leaves.

The full inverse of a penalised covariance counts directions that the penalty has
all but removed. Only as many leading directions of the fitted curve are used as
the term has effective degrees of freedom; a broken rank takes a share of the last
two, and the statistic is then a weighted sum of chi-squares (Wood, 2013).
"""

from __future__ import annotations

import numpy as np


def weighted_chi2_sf(x: float, weights: np.ndarray) -> float:
    """P(sum of weights times independent chi-squares of one degree > x), by numerical inversion."""
    w = np.asarray([v for v in weights if v > 0], float)
    if x <= 0 or len(w) == 0:
        return 1.0 if len(w) else float(x < 0)

    def part(u: np.ndarray) -> np.ndarray:
        angle = 0.5 * np.arctan(np.outer(u, w)).sum(axis=1) - 0.5 * x * u
        size = np.exp(0.25 * np.log1p(np.outer(u * u, w * w)).sum(axis=1))
        return np.sin(angle) / (u * size)

    # The integrand falls as u ** (-1 - k / 2) and turns x / 2 times a unit.
    last = (1e7 ** (2 / (2 + len(w)))) / w.max() + 60.0 / x
    edges = np.concatenate([[0.0], np.geomspace(1e-4 / max(x, w.sum()), last, 400)])
    fine = [np.linspace(a, b, 2 + int((b - a) * x / np.pi)) for a, b in zip(edges, edges[1:])]
    knots = np.unique(np.concatenate(fine))
    nodes, shares = np.polynomial.legendre.leggauss(6)
    half = np.diff(knots) / 2
    middle = (knots[1:] + knots[:-1]) / 2
    u = middle[:, None] + half[:, None] * nodes
    total = float((part(u.ravel()).reshape(u.shape) * shares * half[:, None]).sum())
    return float(min(1.0, max(0.0, 0.5 + total / np.pi)))


def smooth_wald(beta: np.ndarray, cov: np.ndarray, gram: np.ndarray, edf: float) -> tuple[float, float]:
    """(statistic, p) of a smooth with coefficients ``beta``.

    ``cov`` is their covariance given the penalty, ``gram`` the cross products of
    their columns, ``edf`` the effective degrees of freedom.
    """
    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    root = np.sqrt(np.maximum(size, 0))[:, None] * axes.T
    spread, turn = np.linalg.eigh(root @ cov @ root.T)
    spread, turn = spread[::-1], turn[:, ::-1]
    known = int((spread > spread[0] * 1e-10).sum()) if spread[0] > 0 else 0
    if known == 0:
        return 0.0, 1.0
    rank = float(min(max(edf, 1.0), known))
    z = (turn.T @ (root @ beta))[:known] / np.sqrt(spread[:known])
    k = int(np.floor(rank + 1e-9))
    share = rank - k
    if share < 1e-6 or k >= known:
        statistic = float((z[:k] ** 2).sum())
        return statistic, weighted_chi2_sf(statistic, np.ones(k))
    # Either sign of an eigenvector is right: both are used and averaged.
    side = np.sqrt(share * (1 - share) / 2)
    first = (share + 1 + np.sqrt(1 - share * share)) / 2
    weights = np.append(np.ones(k - 1), [first, share + 1 - first])
    whole = float((z[: k - 1] ** 2).sum())
    found = []
    for sign in (1, -1):
        a, b = z[k - 1], sign * z[k]
        found.append(whole + a * a + 2 * side * a * b + share * b * b)
    p = np.mean([weighted_chi2_sf(t, weights) for t in found])
    return float(np.mean(found)), float(p)
