"""Tests of smooth terms and degrees of freedom of contrasts."""

import numpy as np
import pandas as pd

from ectolog.stats import mixed
from ectolog.stats.tails import _t_ppf, chi2_sf
from ectolog.stats.wald import smooth_wald, weighted_chi2_sf


def test_weighted_chi_squares():
    for k in (1, 2, 5, 9):
        for x in (0.5, 3.0, 12.0, 40.0):
            assert abs(weighted_chi2_sf(x, np.ones(k)) - float(chi2_sf(x, k))) < 1e-5
    rng = np.random.default_rng(1)
    w = np.array([1.0, 1.0, 0.93, 0.31])
    draws = (rng.normal(size=(400_000, 4)) ** 2) @ w
    for x in (1.0, 4.0, 9.0, 15.0):
        assert abs(weighted_chi2_sf(x, w) - (draws > x).mean()) < 0.004
    assert weighted_chi2_sf(0.0, w) == 1.0


def penalised(x, y, basis, bend, lam):
    """Dense fit of a centred smooth with a mean; the parts smooth_wald asks for."""
    m = np.column_stack([np.ones(len(x)), basis])
    s = np.zeros((m.shape[1],) * 2)
    s[1:, 1:] = lam * bend
    h = np.linalg.inv(m.T @ m + s)
    beta = h @ m.T @ y
    used = h @ m.T @ m
    rest = y - m @ beta
    sigma2 = rest @ rest / (len(x) - np.trace(used))
    edf = np.diag(2 * used - used @ used)[1:].sum()
    score = len(x) * (rest @ rest) / (len(x) - np.trace(used)) ** 2
    return beta[1:], (sigma2 * h)[1:, 1:], (m.T @ m)[1:, 1:], edf, score


def curves(n=200, k=9):
    """A line, which like that of a spline isn't penalised, and waves, the more bent the more penalised."""
    x = np.linspace(0, 1, n)
    basis = np.column_stack([x] + [np.cos(np.pi * j * x) for j in range(2, k + 1)])
    bend = np.diag([0.0] + [float(j) ** 4 / 16 for j in range(2, k + 1)])
    return x, basis - basis.mean(0), bend


def test_p_is_uniform_without_an_effect():
    """5 % +- 2 % below 0.05, with the smoothness chosen for each curve anew."""
    x, basis, bend = curves()
    rng = np.random.default_rng(11)
    p = []
    for _ in range(600):
        y = rng.normal(size=len(x))
        fits = [penalised(x, y, basis, bend, lam) for lam in 10.0 ** np.arange(-2, 5)]
        beta, cov, gram, edf, _ = min(fits, key=lambda f: f[4])
        p.append(smooth_wald(beta, cov, gram, edf)[1])
    p = np.array(p)
    assert 0.03 <= (p < 0.05).mean() <= 0.07 and 0.4 <= p.mean() <= 0.6
    # A penalty that is given makes the covariance wider than what is seen: the test only errs to the safe side.
    fixed = np.array([smooth_wald(*penalised(x, rng.normal(size=len(x)), basis, bend, 1.0)[:4])[1] for _ in range(600)])
    assert (fixed < 0.05).mean() <= 0.07


def test_curves_are_found_and_no_penalty_is_plain_wald():
    x, basis, bend = curves()
    y = np.sin(3 * x) + np.random.default_rng(2).normal(size=len(x)) * 0.5
    assert smooth_wald(*penalised(x, y, basis, bend, 0.1)[:4])[1] < 1e-4
    beta, cov, gram, edf, _ = penalised(x, y, basis, bend, 0.0)
    statistic, p = smooth_wald(beta, cov, gram, edf)
    plain = beta @ np.linalg.inv(cov) @ beta
    assert abs(edf - 9) < 1e-6 and abs(statistic - plain) < 1e-6 * plain
    assert abs(p - float(chi2_sf(plain, 9))) < 1e-6


def test_contrasts_between_individuals_have_their_number(spark):
    rng = np.random.default_rng(4)
    ids = np.repeat(np.arange(12), 30)
    pdf = pd.DataFrame({"id": ids, "sex": np.where(ids % 2 == 0, "f", "m"), "season": np.tile(["a", "b", "c"], 120)})
    pdf["y"] = rng.normal(size=12)[ids] + rng.normal(size=360)
    fit = mixed.fit_random_intercept(
        spark.createDataFrame(pdf), "y", {"sex": ["f", "m"], "season": ["a", "b", "c"]}, rounds=3
    )
    effects = {r["effect"]: r for r in mixed.anova_mixed(spark, fit).collect()}
    assert effects["sex"]["df2"] == 10 and effects["season"]["df2"] > 300
    sex = mixed.pairwise_contrasts(spark, fit, "sex").first()
    # Two levels: the Tukey test is the t test, and so the F test of the term.
    assert sex["df"] == 10 and abs(sex["p"] - effects["sex"]["p"]) < 1e-4
    season = mixed.pairwise_contrasts(spark, fit, "season").collect()
    assert {r["df"] for r in season} == {effects["season"]["df2"]}
    for r in mixed.marginal_means(spark, fit, ["sex"]).collect():
        assert r["df"] == 10
        assert abs(r["upper_cl"] - r["emmean"] - _t_ppf(0.975, 10) * r["se"]) < 1e-9
