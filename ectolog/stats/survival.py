"""Known-fate survival: rates, covariate models and curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.session import settle


def _binomial_deviance(n: Column, s: Column) -> Column:
    def part(k: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / n)).otherwise(F.lit(0.0))

    return F.lit(-2.0) * (part(s) + part(n - s))


def survival_rate(df: DataFrame, survived: str, by: Sequence[str] = ()) -> DataFrame:
    """Survivors, rate and deviance per group (one row without groups)."""
    alive = F.col(survived).cast("int")
    sums = df.groupBy(*by).agg(F.count(alive).alias("n"), F.sum(alive).alias("survivors"))
    n, s = F.col("n"), F.col("survivors")
    return sums.withColumns({"rate": s / n, "deviance": _binomial_deviance(n, s)})


def survival_models(df: DataFrame, survived: str, group: str) -> DataFrame:
    """Deviance, parameters and size of the constant and the by-group model."""
    cells = survival_rate(df, survived, [group])
    n, s = F.sum("n"), F.sum("survivors")
    const = cells.agg(n.alias("n"), s.alias("_s")).select(
        F.lit("const").alias("model"),
        _binomial_deviance(F.col("n"), F.col("_s")).alias("deviance"),
        F.lit(1).cast("long").alias("k"),
        "n",
    )
    grouped = cells.agg(
        F.lit(group).alias("model"),
        F.sum("deviance").alias("deviance"),
        F.count(F.lit(1)).alias("k"),
        n.alias("n"),
    )
    return const.unionByName(grouped)


# ---- links -----------------------------------------------------------------


def _mean(eta: Column, link: str) -> Column:
    if link == "logit":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    return (F.sin(eta) + 1.0) / 2.0


def _slope(eta: Column, link: str) -> Column:
    """Derivative of the mean by the linear predictor."""
    if link == "logit":
        mu = _mean(eta, link)
        return mu * (F.lit(1.0) - mu)
    return F.cos(eta) / 2.0


@dataclass
class GlmFit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    deviance: float
    n: int
    link: str
    converged: bool = True
    iterations: int = 0
    separated: bool = False

    @property
    def aicc(self) -> float:
        k = len(self.terms)
        return self.deviance + 2 * k + 2 * k * (k + 1) / (self.n - k - 1)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The fit as plain tables, for :func:`ectolog.sources.save_model`."""
        se = np.sqrt(np.diag(self.cov))
        coef = [(t, float(b), float(s)) for t, b, s in zip(self.terms, self.coef, se, strict=True)]
        cov = [
            (a, b, float(self.cov[i, j]))
            for i, a in enumerate(self.terms)
            for j, b in enumerate(self.terms)
        ]
        info = [
            (self.link, float(self.deviance), float(self.aicc), len(self.terms), int(self.n),
             bool(self.converged), int(self.iterations), bool(self.separated))
        ]
        return {
            "coefficients": spark.createDataFrame(coef, "term string, estimate double, se double"),
            "covariance": spark.createDataFrame(cov, "a string, b string, value double"),
            "summary": spark.createDataFrame(
                info, "link string, deviance double, aicc double, k int, n long, "
                "converged boolean, iterations int, separated boolean",
            ),
        }


def survival_glm(
    df: DataFrame,
    survived: str,
    terms: Mapping[str, Column],
    link: str = "logit",
    start: Sequence[float] | None = None,
    tol: float = 1e-10,
    max_iter: int = 60,
) -> GlmFit:
    """Binomial survival model by Fisher scoring.

    Rows are first merged per covariate pattern; every step is then one
    aggregate of (1 + p + p(p+1)/2) sums, and only those reach the driver.
    Errors come from the observed information.
    The sine link ``S = (sin(η) + 1) / 2`` has several optima: scoring starts
    at 0 and so finds the one nearest to no effect.
    """
    names = list(terms)
    patterns = _patterns(df, survived, terms)
    first = [0.0] * len(names) if start is None else list(start)
    return _score(patterns, names, link, [first], tol, max_iter)[0]


def survival_optima(
    df: DataFrame,
    survived: str,
    term: str,
    column: Column,
    starts: Sequence[float],
    link: str = "sine",
) -> list[GlmFit]:
    """Distinct optima of a one-covariate model reached from several starts.

    The trials are merged once and all starts advance together, one pass per
    step; the fits come back by distance of their
    coefficient from 0, so the first is what :func:`survival_glm` reports.
    """
    patterns = _patterns(df, survived, {term: column})
    found: list[GlmFit] = []
    for fit in _score(patterns, [term], link, [[v] for v in starts], 1e-10, 60):
        if all(abs(fit.coef[0] - f.coef[0]) > 1e-4 * (1 + abs(f.coef[0])) for f in found):
            found.append(fit)
    return sorted(found, key=lambda f: abs(f.coef[0]))


def _patterns(df: DataFrame, survived: str, terms: Mapping[str, Column]) -> DataFrame:
    """Trials merged per covariate pattern: x0.., trials n, survivors s."""
    xs = [f"x{i}" for i in range(len(terms))]
    rows = df.select(
        F.col(survived).cast("int").alias("_y"),
        *[c.cast("double").alias(x) for c, x in zip(terms.values(), xs, strict=True)],
    ).na.drop("any")
    return settle(rows.groupBy(*xs).agg(F.count("_y").alias("n"), F.sum("_y").alias("s")))


def _evaluate(
    patterns: DataFrame, betas: np.ndarray, link: str, observed: bool = False
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Deviance, score and information at several coefficient vectors, in one pass.

    The vectors are a literal array exploded next to each pattern, so every
    step runs the same generated code.
    """
    p = betas.shape[1]
    tries = F.array(
        *[
            F.struct(F.lit(j).alias("j"), *[F.lit(float(v)).alias(f"b{i}") for i, v in enumerate(b)])
            for j, b in enumerate(betas)
        ]
    )
    rows = patterns.select("*", F.explode(tries).alias("_t"))
    eta = F.lit(0.0)
    for i in range(p):
        eta = eta + F.col(f"x{i}") * F.col(f"_t.b{i}")
    mu = F.least(F.greatest(_mean(eta, link), F.lit(1e-15)), F.lit(1 - 1e-15))
    n, s = F.col("n"), F.col("s")
    spread = mu * (F.lit(1.0) - mu)
    if link == "logit":
        pull, weight = s - n * mu, n * spread
    else:
        pull, weight = (s - n * mu) * _slope(eta, link) / spread, n.cast("double")
        if observed:
            weight = n - (s - n * mu) * F.sin(eta) / spread / 2.0
    dev = F.lit(-2.0) * (s * F.ln(mu) + (n - s) * F.ln(F.lit(1.0) - mu))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = (
        rows.select(
            F.col("_t.j").alias("_j"), dev.alias("_d"), pull.alias("_u"), weight.alias("_w"),
            *[f"x{i}" for i in range(p)],
        )
        .groupBy("_j")
        .agg(
            F.sum("_d"),
            *[F.sum(F.col("_u") * F.col(f"x{i}")) for i in range(p)],
            *[F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs],
        )
        .collect()
    )
    out: list = [None] * len(betas)
    for row in sums:
        info = np.zeros((p, p))
        for v, (i, j) in zip(row[2 + p :], pairs, strict=True):
            info[i, j] = info[j, i] = v
        out[row[0]] = (float(row[1]), np.array(row[2 : 2 + p], float), info)
    return out


def _score(
    patterns: DataFrame,
    names: list[str],
    link: str,
    starts: Sequence[Sequence[float]],
    tol: float,
    max_iter: int,
) -> list[GlmFit]:
    """Fisher scoring from every start; a step that raises the deviance is halved."""
    total = patterns.agg(F.sum("n")).first()[0]
    betas = np.array([list(map(float, b)) for b in starts])
    state = _evaluate(patterns, betas, link)
    active = list(range(len(betas)))
    halves = 0.5 ** np.arange(1, 13)
    done, rounds = [False] * len(betas), [0] * len(betas)
    for _ in range(max_iter):
        if not active:
            break
        for k in active:
            rounds[k] += 1
        steps = {k: np.linalg.lstsq(state[k][2], state[k][1], rcond=None)[0] for k in active}
        moved = {}
        tried = _evaluate(patterns, np.array([betas[k] + steps[k] for k in active]), link)
        worse = []
        for k, got in zip(active, tried, strict=True):
            if got[0] <= state[k][0] + 1e-12 * abs(state[k][0]):
                moved[k] = (betas[k] + steps[k], got)
            else:
                worse.append(k)
        if worse:
            at = np.array([betas[k] + h * steps[k] for k in worse for h in halves])
            tried = _evaluate(patterns, at, link)
            for i, k in enumerate(worse):
                for j in range(len(halves)):
                    got = tried[i * len(halves) + j]
                    if got[0] <= state[k][0]:
                        moved[k] = (at[i * len(halves) + j], got)
                        break
        left = []
        for k in active:
            if k not in moved:
                # No step helps: an optimum if the score says so, else a failure.
                promise = float(state[k][1] @ steps[k])
                done[k] = abs(promise) <= 1e-6 * (abs(state[k][0]) + 1e-6)
                continue
            gain = state[k][0] - moved[k][1][0]
            betas[k], state[k] = moved[k]
            if abs(gain) >= tol * (abs(state[k][0]) + tol):
                left.append(k)
            else:
                done[k] = True
        active = left

    def perfect(k: int) -> bool:
        """Survivors and others told apart without error: the coefficients have no finite optimum."""
        return bool(names) and state[k][0] < 1e-6 * max(1, total)

    if link != "logit":
        infos = [got[2] for got in _evaluate(patterns, betas, link, observed=True)]
    else:
        infos = [got[2] for got in state]
    return [
        GlmFit(
            names, betas[k], np.linalg.pinv(infos[k]), state[k][0], int(total), link,
            converged=done[k] and not perfect(k), iterations=rounds[k], separated=perfect(k),
        )
        for k in range(len(betas))
    ]


def _penalised_sums(patterns: DataFrame, beta: np.ndarray):
    """Deviance, score and information, and the third moments that the leverages need, in one pass.

    A pattern's leverage is ``n w x'Vx`` with the inverse information ``V``: linear in ``V``,
    so sums of ``n w (1/2 - mu) x x x`` are enough and ``V`` may be known afterwards.
    """
    p = len(beta)
    x = [F.col(f"x{i}") for i in range(p)]
    eta = sum((c * F.lit(float(b)) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    n, s, mu = F.col("n"), F.col("s"), F.col("_mu")
    # ln(1 + e^-|eta|) keeps its digits where the mean is next to 0 or 1.
    low = F.log1p(F.exp(-F.abs(F.col("_eta"))))
    up, down = F.greatest("_eta", F.lit(0.0)), F.greatest(-F.col("_eta"), F.lit(0.0))
    rows = patterns.withColumn("_eta", eta).withColumn("_mu", _mean(F.col("_eta"), "logit"))
    w = n * mu * (F.lit(1.0) - mu)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    triples = [(i, j, k) for i, j in pairs for k in range(j, p)]
    row = rows.agg(
        F.sum(F.lit(2.0) * (s * (down + low) + (n - s) * (up + low))),
        *[F.sum((s - n * mu) * c) for c in x],
        *[F.sum(w * x[i] * x[j]) for i, j in pairs],
        *[F.sum(w * (F.lit(0.5) - mu) * x[i] * x[j] * x[k]) for i, j, k in triples],
    ).first()
    info, third = np.zeros((p, p)), np.zeros((p, p, p))
    for v, (i, j) in zip(row[1 + p :], pairs):
        info[i, j] = info[j, i] = v
    for v, at in zip(row[1 + p + len(pairs) :], triples, strict=True):
        for order in permutations(at):
            third[order] = v
    return float(row[0]), np.array(row[1 : 1 + p], float), info, third


def survival_penalised(
    df: DataFrame, survived: str, terms: Mapping[str, Column], tol: float = 1e-14, max_iter: int = 100
) -> GlmFit:
    """Logit survival model by Firth's penalised score, finite also where the data are separated.

    The likelihood is multiplied by the root of the information's determinant.
    Trials are merged per covariate pattern; a step is one aggregate of
    O(p^3) sums, halved while the penalised likelihood falls; ``tol`` bounds the squared
    distance left, in standard errors. ``deviance`` is that
    of the unpenalised likelihood. Rows with a null are left out; without rows, or with terms
    that depend on each other, ValueError is raised.
    """
    names = list(terms)
    patterns = _patterns(df, survived, terms)
    total = patterns.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no row with an outcome and all terms")

    def state(at: np.ndarray):
        deviance, score, info, third = _penalised_sums(patterns, at)
        sign, log_det = np.linalg.slogdet(info)
        return deviance - (log_det if sign > 0 else -np.inf), deviance, score, info, third

    beta = np.zeros(len(names))
    now = state(beta)
    size = np.sqrt(np.diag(now[3]))
    if not size.all() or np.linalg.matrix_rank(now[3] / np.outer(size, size), tol=1e-10) < len(names):
        raise ValueError("the terms depend on each other")
    done, rounds = False, 0
    while not done and rounds < max_iter:
        rounds += 1
        cov = np.linalg.inv(now[3])
        pull = now[2] + np.einsum("jkl,kl->j", now[4], cov)
        step = cov @ pull
        if abs(pull @ step) < tol:
            done = True
            break
        for half in range(20):
            tried = state(beta + 0.5**half * step)
            if tried[0] <= now[0] + 1e-12 * (1 + abs(now[0])):
                beta, now = beta + 0.5**half * step, tried
                break
        else:
            break
    return GlmFit(
        names, beta, np.linalg.inv(now[3]), now[1], int(total), "logit", converged=done, iterations=rounds
    )


def survival_curve(
    grid: DataFrame, fit: GlmFit, terms: Mapping[str, Column], z: float = 1.959963984540054
) -> DataFrame:
    """Survival with delta-method error along a grid; limits on the logit scale."""
    xs = [terms[t].cast("double") for t in fit.terms]
    eta = sum((x * float(b) for x, b in zip(xs, fit.coef, strict=True)), F.lit(0.0))
    var = F.lit(0.0)
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            var = var + a * b * float(fit.cov[i, j])
    out = (
        grid.withColumn("_eta", eta)
        .withColumn("survival", _mean(F.col("_eta"), fit.link))
        .withColumn("se", F.abs(_slope(F.col("_eta"), fit.link)) * F.sqrt(var))
    )
    s = F.col("survival")
    logit = F.ln(s / (F.lit(1.0) - s))
    half = F.lit(z) * F.col("se") / (s * (F.lit(1.0) - s))
    return out.withColumns(
        {
            "lci": F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit - half))),
            "uci": F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit + half))),
        }
    ).drop("_eta")
