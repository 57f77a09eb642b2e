"""Design columns of factor and spline terms, as Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def spline_columns(x: Column, lo: float, hi: float, size: int) -> list[Column]:
    """Cubic B-splines on evenly spaced knots over [lo, hi]; they sum to 1."""
    width = (hi - lo) / (size - 3)
    at = (x - F.lit(float(lo))) / F.lit(float(width))
    out = []
    for j in range(size):
        u = F.abs(at - F.lit(float(j - 1)))
        near = F.lit(2.0 / 3.0) - u * u + u * u * u / 2.0
        far = (F.lit(2.0) - u) * (F.lit(2.0) - u) * (F.lit(2.0) - u) / 6.0
        out.append(F.when(u < 1, near).when(u < 2, far).otherwise(F.lit(0.0)))
    return out


def spline_values(x: np.ndarray, lo: float, hi: float, size: int) -> np.ndarray:
    """The same splines for driver-side grids."""
    at = (np.asarray(x, float) - lo) / ((hi - lo) / (size - 3))
    u = np.abs(at[:, None] - (np.arange(size) - 1)[None, :])
    near = 2 / 3 - u**2 + u**3 / 2
    far = (2 - u) ** 3 / 6
    return np.where(u < 1, near, np.where(u < 2, far, 0.0))


def curvature(size: int) -> np.ndarray:
    """Second-difference penalty matrix."""
    d = np.diff(np.eye(size), n=2, axis=0)
    return d.T @ d


@dataclass
class Design:
    """Fixed part: intercept, factors (treatment coding), interactions, spline."""

    factors: dict[str, list[str]] = field(default_factory=dict)
    interactions: list[tuple[str, ...]] = field(default_factory=list)
    x: str | None = None
    by: str | None = None
    lo: float = 0.0
    hi: float = 1.0
    size: int = 10

    def terms(self) -> list[tuple[str, ...]]:
        return [(f,) for f in self.factors] + [tuple(i) for i in self.interactions]

    def _factor_columns(self) -> list[tuple[str, tuple[str, ...], dict[str, str]]]:
        """(name, term, level of each factor) of every factor column."""
        out = [("(intercept)", (), {})]
        for term in self.terms():
            for combo in product(*[self.factors[f][1:] for f in term]):
                name = ":".join(f"{f}[{lv}]" for f, lv in zip(term, combo, strict=True))
                out.append((name, term, dict(zip(term, combo, strict=True))))
        return out

    def names(self) -> list[str]:
        out = [name for name, _, _ in self._factor_columns()]
        for level in self._levels():
            tag = f"s({self.x})" if level is None else f"s({self.x}):{level}"
            out += [f"{tag}.{j}" for j in range(1, self.size)]
        return out

    def _levels(self) -> list[str | None]:
        if self.x is None:
            return []
        return list(self.factors[self.by]) if self.by else [None]

    def columns(self) -> list[Column]:
        out = []
        for _, _, levels in self._factor_columns():
            col = F.lit(1.0)
            for f, lv in levels.items():
                col = col * F.when(F.col(f) == lv, 1.0).otherwise(0.0)
            out.append(col)
        for level in self._levels():
            # The first spline is left out: its constant is in the intercept.
            splines = spline_columns(F.col(self.x).cast("double"), self.lo, self.hi, self.size)[1:]
            if level is not None:
                on = F.when(F.col(self.by) == level, 1.0).otherwise(0.0)
                splines = [s * on for s in splines]
            out += splines
        return out

    def codes(self) -> list[Column]:
        """Number of each factor's level as ``_f_<factor>``, -1 for others; what :meth:`values` reads."""
        out = []
        for f, levels in self.factors.items():
            code = F.lit(-1)
            for i, level in enumerate(levels):
                code = F.when(F.col(f) == level, i).otherwise(code)
            out.append(code.cast("int").alias(f"_f_{f}"))
        x = F.lit(0.0) if self.x is None else F.col(self.x).cast("double")
        return [*out, x.alias("_x")]

    def values(self, codes: Mapping[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        """Design rows inside a task, from the columns of :meth:`codes`."""
        out = []
        for _, _, levels in self._factor_columns():
            col = np.ones(len(x))
            for f, lv in levels.items():
                col = col * (codes[f"_f_{f}"] == self.factors[f].index(lv))
            out.append(col[:, None])
        for level in self._levels():
            splines = spline_values(x, self.lo, self.hi, self.size)[:, 1:]
            if level is not None:
                splines = splines * (codes[f"_f_{self.by}"] == self.factors[self.by].index(level))[:, None]
            out.append(splines)
        return np.concatenate(out, axis=1)

    def row(self, levels: Mapping[str, str]) -> np.ndarray:
        """Factor part of one design row (spline columns 0)."""
        cols = self._factor_columns()
        got = [float(all(levels.get(f) == lv for f, lv in need.items())) for _, _, need in cols]
        return np.r_[got, np.zeros(len(self.names()) - len(got))]

    def matrix(self, levels: Sequence[Mapping[str, str]], x: np.ndarray) -> np.ndarray:
        """Driver-side design rows for a small grid."""
        out = np.array([self.row(lv) for lv in levels])
        if self.x is None:
            return out
        start = len(self._factor_columns())
        splines = spline_values(x, self.lo, self.hi, self.size)[:, 1:]
        for i, level in enumerate(self._levels()):
            on = np.array([level is None or lv.get(self.by) == level for lv in levels], float)
            at = start + i * (self.size - 1)
            out[:, at : at + self.size - 1] = splines * on[:, None]
        return out

    def penalty(self) -> np.ndarray:
        """Curvature penalty of the spline columns, 0 elsewhere."""
        names = self.names()
        out = np.zeros((len(names), len(names)))
        start = len(self._factor_columns())
        one = curvature(self.size)[1:, 1:]
        for i, _ in enumerate(self._levels()):
            at = start + i * (self.size - 1)
            out[at : at + self.size - 1, at : at + self.size - 1] = one
        return out

    def spline_blocks(self) -> dict[str, list[int]]:
        start = len(self._factor_columns())
        out = {}
        for i, level in enumerate(self._levels()):
            tag = f"s({self.x})" if level is None else f"s({self.x}):{level}"
            at = start + i * (self.size - 1)
            out[tag] = list(range(at, at + self.size - 1))
        return out

    def grid(self, names: Sequence[str]) -> list[dict[str, str]]:
        """All level combinations of some factors."""
        return [
            dict(zip(names, combo, strict=True))
            for combo in product(*[self.factors[n] for n in names])
        ]
