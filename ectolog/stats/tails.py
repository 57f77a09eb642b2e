"""Tail probabilities of t, F, chi-square and the studentised range.

Vectorised helpers for summary rows; they never see raw readings.
"""

from __future__ import annotations

from math import erf, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _each(fn, a) -> np.ndarray:
    a = np.asarray(a, float)
    return np.array([fn(v) for v in a.ravel()]).reshape(a.shape)


def _lgamma(a) -> np.ndarray:
    return _each(lgamma, a)


def _erf(a) -> np.ndarray:
    return _each(erf, a)



def _beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)
        ) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            for term in (even, odd):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + term / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0.0) < 1e-15:
                break
        out = front * h
    out = np.where(y <= 0, 0.0, out)
    out = np.where(flip, 1 - out, out)
    return np.where(np.isnan(a + b + x), np.nan, out)


def f_sf(f, d1, d2) -> np.ndarray:
    """Upper tail of F."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    big = d2 > 1e7
    safe = np.where(big, 1.0, d2)
    with np.errstate(all="ignore"):
        out = _beta_inc(safe / 2, d1 / 2, safe / (safe + d1 * np.maximum(f, 0)))
        return np.where(big, chi2_sf(d1 * f, d1), out)


def t_two_sided(t, df) -> np.ndarray:
    t = np.asarray(t, float)
    return f_sf(t * t, 1.0, df)


#: Degrees of freedom from which the chi-square tail is taken from the normal one.
CHI2_NORMAL_DF = 1e4


def chi2_sf(x, k) -> np.ndarray:
    """Upper tail of chi-square through the incomplete gamma function; NaN if it doesn't settle."""
    x, k = np.broadcast_arrays(np.asarray(x, float) / 2, np.asarray(k, float) / 2)
    with np.errstate(all="ignore"):
        # Many degrees of freedom: the cube root of chi-square over k is normal
        # (Wilson and Hilferty), with an error far below 1e-4 here.
        many = k >= CHI2_NORMAL_DF / 2
        cube = np.cbrt(x / k)
        spread = 1 / (9 * k)
        normal = 0.5 * (1 - _erf((cube - (1 - spread)) / np.sqrt(2 * spread)))
        all_k, all_x = k, x
        k, x = np.where(many, 1.0, k), np.where(many, 1.0, x)
        lead = np.exp(k * np.log(x) - x - _lgamma(np.where(k > 0, k, 1.0)))
        # Below that, terms and fractions until nothing changes: some ten times
        # the square root of k, and far less away from the middle.
        most = int(600 + 40 * np.sqrt(np.nanmax(k, initial=1.0)))
        term = 1 / k
        low = term.copy()
        low_done = np.zeros(x.shape, bool)
        for n in range(1, most):
            term = term * x / (k + n)
            low = low + term
            low_done = term <= 1e-17 * low
            if np.all(low_done | (x >= k + 1) | np.isnan(x)):
                break
        b = x + 1 - k
        c = np.full_like(x, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        high_done = np.zeros(x.shape, bool)
        for i in range(1, most):
            an = -i * (i - k)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * c * d
            high_done = np.abs(c * d - 1) < 1e-15
            if np.all(high_done | (x < k + 1) | np.isnan(x)):
                break
        low_side = np.where(low_done, 1 - lead * low, np.nan)
        high_side = np.where(high_done | ~(lead > 0), lead * h, np.nan)
        out = np.where(many, normal, np.where(x < k + 1, low_side, high_side))
    return np.where(all_x <= 0, 1.0, np.where(np.isnan(all_k), np.nan, out))


def _norm_ppf(p: float) -> float:
    """Normal quantile for p > 0.5 by bisection on the error function."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + erf(mid / 2**0.5)) < p else (lo, mid)
    return (lo + hi) / 2


def _t_ppf(p: float, df: float) -> float:
    """Quantile of t for p > 0.5: Newton steps kept inside a bracket."""
    if not df > 0 or np.isnan(p):
        return float("nan")
    tail = 2 * (1 - p)
    t = _norm_ppf(p)
    lo, hi = 0.0, max(2 * t, 1.0)
    while t_two_sided(hi, df) > tail and hi < 1e12:
        lo, hi = hi, hi * 2
    const = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(df * np.pi)
    t = min(max(t, lo), hi)
    for _ in range(100):
        miss = float(t_two_sided(t, df)) - tail
        lo, hi = (t, hi) if miss > 0 else (lo, t)
        slope = 2 * np.exp(const - (df + 1) / 2 * np.log1p(t * t / df))
        step = t + miss / slope
        new = step if lo < step < hi else (lo + hi) / 2
        if abs(new - t) < 1e-13 * max(1.0, t):
            return new
        t = new
    return t


def _norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / np.sqrt(2)))


def range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range by Gauss-Legendre quadrature."""
    if np.isnan(q) or q <= 0:
        return float("nan") if np.isnan(q) else 1.0
    nodes, weights = np.polynomial.legendre.leggauss(128)
    z = 8.5 * nodes
    dz = 8.5 * weights * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    base = _norm_cdf(z)

    def normal_range(w: np.ndarray) -> np.ndarray:
        gap = base[None, :] - _norm_cdf(z[None, :] - w[:, None])
        return k * (dz[None, :] * np.clip(gap, 0, 1) ** (k - 1)).sum(axis=1)

    if not np.isfinite(df) or df > 2e4:
        return float(max(0.0, 1 - normal_range(np.array([q]))[0]))
    spread = 10 / np.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread
    s = (hi - lo) / 2 * nodes + (hi + lo) / 2
    log_f = (
        (df / 2) * np.log(df / 2) - lgamma(df / 2) + np.log(2)
        + (df - 1) * np.log(s) - df * s * s / 2
    )
    ds = (hi - lo) / 2 * weights * np.exp(log_f)
    return float(max(0.0, 1 - (ds * normal_range(q * s)).sum() / ds.sum()))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), k.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    cache = {k: _t_ppf(*k) for k in set(zip(p, df, strict=True))}
    return pd.Series([cache[k] for k in zip(p, df, strict=True)])


@F.pandas_udf(DoubleType())
def tukey_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([range_sf(*v) for v in zip(q, k, df, strict=True)])
