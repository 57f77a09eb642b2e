"""Penalised survival score against a dense computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ectolog.stats import survival


def dense(x, y):
    """Firth's estimate by steps on whole matrices, leverages from the hat matrix."""
    beta = np.zeros(x.shape[1])
    for _ in range(5_000):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = mu * (1 - mu)
        v = np.linalg.inv(x.T @ (w[:, None] * x))
        h = w * np.einsum("ij,jk,ik->i", x, v, x)
        beta = beta + 0.5 * v @ (x.T @ (y - mu + h * (0.5 - mu)))
    return beta, v


def frame(spark, x, y):
    rows = [(bool(b), *map(float, a)) for a, b in zip(x[:, 1:], y, strict=True)]
    names = [f"c{k}" for k in range(1, x.shape[1])]
    df = spark.createDataFrame(rows, "survived boolean, " + ", ".join(f"{n} double" for n in names))
    return df, {"one": F.lit(1.0), **{n: F.col(n) for n in names}}


@pytest.mark.parametrize("kind", ["separated", "mixed", "quasi"])
def test_as_a_dense_computation(spark, kind):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(27), rng.normal(size=27).round(1), rng.integers(0, 2, 27)])
    y = {
        "separated": x[:, 1] > 0.2,
        "mixed": rng.random(27) < 0.5,
        "quasi": (x[:, 2] == 1) & (rng.random(27) < 0.6),
    }[kind].astype(float)
    df, terms = frame(spark, np.vstack([x, x[:5]]), np.concatenate([y, y[:5]]))
    fit = survival.survival_penalised(df.repartition(3), "survived", terms)
    beta, cov = dense(np.vstack([x, x[:5]]), np.concatenate([y, y[:5]]))
    assert fit.converged and fit.n == 32
    assert list(fit.coef) == pytest.approx(list(beta), rel=1e-4, abs=1e-4)
    assert fit.cov == pytest.approx(cov, rel=1e-3, abs=1e-4)
    if kind == "separated":
        assert survival.survival_glm(df, "survived", terms).separated


def test_halves_added_to_one_group(spark):
    """An intercept alone: half a survivor and half a death more, whatever the counts."""
    for alive, dead in ((7, 0), (0, 3), (4, 9)):
        df = spark.createDataFrame([(True,)] * alive + [(False,)] * dead + [(None,)], "survived boolean")
        fit = survival.survival_penalised(df, "survived", {"one": F.lit(1.0)})
        assert fit.coef[0] == pytest.approx(np.log((alive + 0.5) / (dead + 0.5)), abs=1e-5)
        assert fit.n == alive + dead


def test_terms_that_cannot_be_told_apart_are_refused(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0)], "survived boolean, a double")
    for terms in ({"a": F.col("a"), "b": 2 * F.col("a")}, {"a": F.col("a"), "zero": F.lit(0.0)}):
        with pytest.raises(ValueError, match="depend"):
            survival.survival_penalised(df, "survived", terms)
    with pytest.raises(ValueError, match="no row"):
        survival.survival_penalised(df.limit(0), "survived", {"a": F.col("a")})
