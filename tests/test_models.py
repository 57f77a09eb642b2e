"""Mixed and additive models against dense linear algebra; tail probabilities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ectolog.stats import anova, mixed, ols, tails
from ectolog.stats.design import spline_values

FACTORS = {"sex": ["ZWf", "ZZm"], "season": ["Spring", "Summer", "Autumn"]}
IDS = 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 360
    ids = rng.integers(0, IDS, n)
    sex = np.where(ids % 2 == 0, "ZWf", "ZZm")
    season = rng.choice(FACTORS["season"], n)
    x = np.round(rng.uniform(5, 40, n))
    y = 3 + rng.normal(0, 1.2, IDS)[ids] + (sex == "ZZm") + 2 * (season == "Summer")
    y = y + 2 * np.sin(x / 6) + rng.normal(0, 1, n)
    return pd.DataFrame({"id": ids.astype("int64"), "sex": sex, "season": season, "temp": x, "y": y})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(6)


def levels(data):
    return [{"sex": a, "season": b} for a, b in zip(data["sex"], data["season"], strict=True)]


def test_random_intercept_is_the_reml_optimum(df, data):
    fit = mixed.fit_random_intercept(df, "y", FACTORS, interactions=[("season", "sex")])
    x = fit.design.matrix(levels(data), data["temp"].to_numpy())
    y, z = data["y"].to_numpy(), np.eye(IDS)[data["id"]]

    def criterion(rho):
        v = np.eye(len(y)) + z @ z.T / rho
        vi = np.linalg.inv(v)
        h = x.T @ vi @ x
        beta = np.linalg.solve(h, x.T @ vi @ y)
        s2 = (y - x @ beta) @ vi @ (y - x @ beta) / (len(y) - x.shape[1])
        value = np.linalg.slogdet(v)[1] + np.linalg.slogdet(h)[1]
        return (len(y) - x.shape[1]) * (np.log(2 * np.pi * s2) + 1) + value, beta, s2, h

    rho = float(fit.block_penalty[0, 0])
    value, beta, s2, h = criterion(rho)
    assert fit.reml == pytest.approx(value, abs=1e-6)
    assert fit.beta == pytest.approx(beta, abs=1e-8)
    assert fit.sigma2 == pytest.approx(s2, rel=1e-9)
    assert fit.cov == pytest.approx(s2 * np.linalg.inv(h), abs=1e-9)
    best = min(criterion(10**t)[0] for t in np.arange(-2, 3, 0.01))
    assert fit.reml <= best + 1e-6
    # The variance itself, against an optimum a thousand times finer than the first grid.
    low, high = np.log10(rho) - 0.05, np.log10(rho) + 0.05
    for _ in range(60):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if criterion(10**a)[0] < criterion(10**b)[0] else (a, high)
    best_rho = 10 ** ((low + high) / 2)
    assert fit.var_id == pytest.approx(criterion(best_rho)[2] / best_rho, rel=1e-4)
    assert fit.edge is None


def test_no_variance_between_individuals_is_flagged(spark):
    """Individuals whose means agree exactly: the variance is 0, not something small."""
    pdf = pd.DataFrame({"id": np.repeat(np.arange(20), 10), "y": np.tile(np.arange(10.0), 20)})
    fit = mixed.fit_random_intercept(spark.createDataFrame(pdf), "y", {})
    assert fit.var_id == 0.0 and fit.edge == "none"


def test_rows_are_one_set(df):
    with pytest.raises(ValueError, match="not listed"):
        mixed.fit_random_intercept(df, "y", {"sex": ["ZWf"]})
    one = {"sex": ["ZWf"]}
    fits = {
        "a": mixed.fit_random_intercept(mixed.listed_rows(df, one), "y", one),
        "b": mixed.fit_random_intercept(df, "y", {"sex": ["ZWf", "ZZm"]}),
    }
    with pytest.raises(ValueError, match="different readings"):
        mixed.fits_table(df.sparkSession, fits)


def test_no_individual_variance_is_least_squares(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(200), "sex": np.tile(["ZWf", "ZZm"], 100)})
    pdf["y"] = rng.normal(0, 1, 200) + (pdf["sex"] == "ZZm")
    fit = mixed.fit_random_intercept(
        spark.createDataFrame(pdf), "y", {"sex": ["ZWf", "ZZm"]}
    )
    means = pdf.groupby("sex")["y"].mean()
    assert fit.beta == pytest.approx([means["ZWf"], means["ZZm"] - means["ZWf"]], abs=1e-6)


@pytest.mark.parametrize(
    "options", [{}, {"id": "id"}, {"id": "id", "by": "sex"}, {"id": "id", "id_curves": True}]
)
def test_smooth_equals_dense_solution(df, data, options):
    fit = mixed.fit_smooth(df, "y", "temp", FACTORS, rounds=2, **options)
    d = fit.design
    temps, y = data["temp"].to_numpy(), data["y"].to_numpy() - fit.center
    x = d.matrix(levels(data), temps)
    n, p = x.shape
    z = {
        None: np.zeros((n, 0)),
        "intercept": np.ones((n, 1)),
        "curve": spline_values(temps, d.lo, d.hi, d.size),
    }[fit.kind]
    k = z.shape[1]
    m, pen = np.zeros((n, p + IDS * k)), np.zeros((p + IDS * k,) * 2)
    m[:, :p], pen[:p, :p] = x, fit.smooth_penalty * d.penalty()
    for i in range(IDS if k else 0):
        at = p + i * k
        m[data["id"] == i, at : at + k] = z[data["id"] == i]
        pen[at : at + k, at : at + k] = fit.block_penalty
    h = m.T @ m + pen
    coef = np.linalg.solve(h, m.T @ y)
    fitted = m @ coef
    assert fit.coef == pytest.approx(coef[:p], abs=1e-6)
    assert fit.rss == pytest.approx(((y - fitted) ** 2).sum(), rel=1e-6)
    assert fit.edf == pytest.approx(np.trace(np.linalg.solve(h, m.T @ m)), abs=1e-5)

    pred = mixed.predict_fit(fit).toPandas()
    se = np.sqrt(fit.sigma2 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(h), m))
    dense = data.assign(want=fitted + fit.center, want_se=se)
    keys = [c for c in pred.columns if c in data.columns]
    both = pred.merge(dense.drop_duplicates(keys), on=keys)
    assert len(both) == len(pred)
    assert both["fit"].to_numpy() == pytest.approx(both["want"].to_numpy(), abs=1e-5)
    assert both["se"].to_numpy() == pytest.approx(both["want_se"].to_numpy(), abs=1e-5)


def test_predicting_new_rows_equals_predicting_data(df):
    fit = mixed.fit_smooth(df, "y", "temp", FACTORS, id="id", id_curves=True, rounds=1)
    seen = mixed.predict_fit(fit).orderBy("id", "temp", "sex", "season")
    asked = mixed.predict_fit(fit, new=seen.drop("fit", "se"))
    a = seen.toPandas()
    b = asked.orderBy("id", "temp", "sex", "season").toPandas()
    assert a["fit"].to_numpy() == pytest.approx(b["fit"].to_numpy())
    assert a["se"].to_numpy() == pytest.approx(b["se"].to_numpy())


def test_summary_tables(spark, df):
    fit = mixed.fit_random_intercept(df, "y", FACTORS, interactions=[("season", "sex")])
    effects = [r["effect"] for r in mixed.anova_mixed(spark, fit).collect()]
    assert effects == ["sex", "season", "season:sex"]
    cells = mixed.marginal_means(spark, fit, ["season", "sex"])
    assert cells.count() == 6
    over = {r["season"]: r["emmean"] for r in mixed.marginal_means(spark, fit, ["season"]).collect()}
    mean = {r[0]: r[1] for r in cells.groupBy("season").avg("emmean").collect()}
    assert over == pytest.approx(mean)
    pairs = mixed.pairwise_contrasts(spark, fit, "season").collect()
    first = next(r for r in pairs if r["contrast"] == "Spring - Summer")
    assert first["estimate"] == pytest.approx(over["Spring"] - over["Summer"])
    within = mixed.pairwise_contrasts(spark, fit, "sex", within="season")
    assert within.count() == 3


def test_batches_never_split_an_individual():
    from ectolog.stats.blocks import whole_ids

    whole = pd.DataFrame({"_id": [1, 1, 2, 2, 2, 3, 4, 4], "v": range(8)})
    for size in range(1, 9):
        parts = [whole.iloc[i : i + size] for i in range(0, 8, size)]
        out = list(whole_ids(iter(parts), "_id"))
        assert [v for p in out for v in p["v"]] == list(range(8))
        owners = [i for p in out for i in p["_id"].unique()]
        assert owners == [1, 2, 3, 4]


# Textbook tail probabilities.
def test_tails():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_sf(3.492828, 2, 20) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.range_sf(3.958293, 4, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.range_sf(3.633160, 4, float("inf")) == pytest.approx(0.05, abs=1e-5)
    assert tails._t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert tails._t_ppf(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)


def test_regression_by_hand(spark, data):
    df = spark.createDataFrame(data)
    fit = ols.fit_ols(df, "y", "temp", p=True).first()
    x = np.c_[np.ones(len(data)), data["temp"]]
    coef, rss, _, _ = np.linalg.lstsq(x, data["y"], rcond=None)
    cov = rss[0] / (len(data) - 2) * np.linalg.inv(x.T @ x)
    assert (fit["intercept"], fit["slope"]) == pytest.approx(tuple(coef))
    assert (fit["se_intercept"], fit["se_slope"]) == pytest.approx(tuple(np.sqrt(np.diag(cov))))
    assert fit["p_slope"] == pytest.approx(
        float(tails.t_two_sided(fit["t_slope"], len(data) - 2))
    )
    band = ols.ols_confint(ols.fit_ols(df, "y", "temp")).first()
    assert band["slope_lower"] < fit["slope"] < band["slope_upper"]


def test_two_points_have_no_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    fit = ols.fit_ols(df, "y", "x").first()
    assert fit["slope"] == 2.0 and fit["sigma"] is None and fit["se_slope"] is None


def test_null_group_level_is_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "g string, y double")
    means = {r["g"]: r["mean"] for r in anova.fit_group_means(df, "y", "g").collect()}
    assert means == {"a": 2.0, None: 4.0}
    by = {r["h"]: r["se"] for r in anova.fit_group_means(
        df.withColumn("h", F.col("g")), "y", "g", by=["h"]).collect()}
    assert set(by) == {"a", None} and all(v is not None for v in by.values())


def test_passes_over_penalties_read_one_row_an_individual(df):
    """Cells are read once for a model; every later pass reads stored sums."""
    from ectolog.stats import blocks

    fit = mixed.fit_smooth(df, "y", "temp", FACTORS, id="id", id_curves=True, rounds=1)
    parts = blocks.individual_parts(fit.cells, "id", fit.design, "curve")
    assert parts.blocks.count() == fit.ids < fit.cells.count()
    again = blocks.block_sums(parts, [fit.block_penalty])[0]
    got = mixed._solve(again, fit.smooth_penalty * fit.design.penalty(), 0, 0.0)
    assert got["beta"] == pytest.approx(fit.coef, abs=1e-8)


def test_design_rows_of_tasks_equal_columns(df):
    from ectolog.stats.design import Design

    d = Design(FACTORS, [("season", "sex")], x="temp", by="sex", lo=0.0, hi=40.0)
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(d.columns())], *d.codes()).toPandas()
    made = d.values({c: rows[c].to_numpy() for c in rows if c.startswith("_f_")}, rows["_x"].to_numpy(float))
    assert made == pytest.approx(rows.filter(regex="^c[0-9]").to_numpy(float), abs=1e-12)


@pytest.mark.parametrize("options", [{}, {"id": "id"}, {"id": "id", "id_curves": True}])
def test_fits_of_shared_cells_equal_fits_of_their_own(df, options):
    shared = mixed.smooth_cells(df, "y", "temp", FACTORS, "id")
    few = {"sex": FACTORS["sex"]}
    a, b = (mixed.fit_smooth(rows, "y", "temp", few, rounds=1, **options) for rows in (df, shared))
    assert (a.n, a.ids) == (b.n, b.ids)
    assert b.rss == pytest.approx(a.rss) and b.aic == pytest.approx(a.aic)
    x, y = (mixed.predict_fit(f).toPandas() for f in (a, b))
    by = [c for c in x.columns if c in ("id", "temp", "sex")]
    x, y = (t.drop_duplicates(by).sort_values(by) for t in (x, y))
    assert len(x) == len(y) and y["fit"].to_numpy() == pytest.approx(x["fit"].to_numpy())
    with pytest.raises(ValueError, match="other factors"):
        mixed.fit_smooth(shared, "y", "temp", {"sex": ["ZZx"]}, **options)
