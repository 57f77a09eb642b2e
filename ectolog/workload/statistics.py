"""Statistical operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ectolog.functions import SEASONS
from ectolog.operators import aggregate, clean, joins
from ectolog.plans import effectiveness, field, habitat, performance, tables
from ectolog.session import settle
from ectolog.stats import anova, compare, mixed, ols, survival
from ectolog.workload.composites import DEV, SURV_MODELS, WEIGHTS
from ectolog.workload.registry import query
from ectolog.workload.composites import quality
from ectolog.workload.relational import curve, minutes, observed_predicted, prediction_grid, with_tb

_FIT = """I{{n}} AS n, R{{slope}} AS slope, R{{ic}} AS intercept, R{{r2}} AS r2, R{{sxx}} AS sxx,
    R{{xm}} AS x_mean, R{{x0}} AS x_min, R{{x1}} AS x_max, R{{sg}} AS sigma, R{{sg / sqrt(sxx)}} AS se_slope,
    R{{sg * sqrt(1.0 / n + xm * xm / sxx)}} AS se_intercept, R{{slope / (sg / sqrt(sxx))}} AS t_slope,
    R{{ic / (sg * sqrt(1.0 / n + xm * xm / sxx))}} AS t_intercept""".replace("{{", "{").replace("}}", "}")


def _fit_cte(y: str, x: str, by: str = "") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""sums AS (SELECT {keys}regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope,
        regr_intercept({y}, {x}) AS ic, regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx,
        regr_avgx({y}, {x}) AS xm, min({x}) AS x0, max({x}) AS x1,
        regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM pairs {group}),
    fit AS (SELECT *, sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) AS sg FROM sums)"""


@query("fit_ols", f"WITH {_fit_cte('y', 'x')} SELECT {_FIT} FROM fit", digits=4)
def fit_ols(v):
    return ols.fit_ols(v.pairs, "y", "x")


@query("fit_ols_by", f"WITH {_fit_cte('y', 'x', 'id')} SELECT id, {_FIT} FROM fit", digits=4)
def fit_ols_by(v):
    return ols.fit_ols(v.pairs, "y", "x", by=["id"])


@query("ols_confint")
def ols_confint(v):
    return ols.ols_confint(ols.fit_ols(v.pairs, "y", "x", by=["type"], p=True))


@query(
    "ols_band",
    f"""WITH {_fit_cte('y', 'x', 'id')}
        SELECT id, R{{x}} AS x, R{{ic + slope * x}} AS fit,
               R{{sg * sqrt(1.0 / n + (x - xm) * (x - xm) / sxx)}} AS se
        FROM (SELECT *, x0 + (x1 - x0) * i / 79.0 AS x FROM fit CROSS JOIN (SELECT unnest(range(80)) AS i))""",
    digits=4,
)
def ols_band(v):
    return ols.ols_band(v.pairs, "y", "x", by=["id"], ci=False)


@query("ols_band_limits")
def ols_band_limits(v):
    return ols.ols_band(v.pairs, "y", "x")


_CELLS = """cell AS (SELECT type, count(y) AS n, avg(y) AS mean, var_pop(y) * count(y) AS ss
            FROM pairs GROUP BY type),
    tot AS (SELECT count(*) AS g, sum(n) AS nt, sum(ss) AS ssw,
            sum(n * (mean - m) * (mean - m)) AS ssb
            FROM cell CROSS JOIN (SELECT sum(n * mean) / sum(n) AS m FROM cell))"""


@query(
    "fit_group_means",
    f"""WITH {_CELLS} SELECT type, I{{n}} AS n, R{{mean}} AS mean, R{{sqrt(ssw / (nt - g) / n)}} AS se,
        I{{nt - g}} AS df FROM cell CROSS JOIN tot""",
)
def fit_group_means(v):
    return anova.fit_group_means(v.pairs, "y", "type")


@query(
    "anova_oneway",
    f"""WITH {_CELLS} SELECT I{{g - 1}} AS df1, I{{nt - g}} AS df2, R{{ssb}} AS ss_between,
        R{{ssw}} AS ss_within, R{{(ssb / (g - 1)) / (ssw / (nt - g))}} AS f FROM tot""",
    digits=3,
)
def anova_oneway(v):
    return anova.anova_oneway(v.pairs, "y", "type")


@query("anova_oneway_p")
def anova_oneway_p(v):
    return anova.anova_oneway(v.pairs, "y", "type", p=True)


@query(
    "anova_regression",
    """SELECT I{1} AS df1, I{n - 2} AS df2, R{ssm} AS ss_model, R{syy - ssm} AS ss_residual,
              R{ssm / ((syy - ssm) / (n - 2))} AS f
       FROM (SELECT regr_count(y, x) AS n, regr_syy(y, x) AS syy,
                    regr_slope(y, x) * regr_sxy(y, x) AS ssm FROM pairs)""",
    digits=3,
)
def anova_regression(v):
    return anova.anova_regression(v.pairs, "y", "x")


@query(
    "pairwise_contrasts",
    f"""WITH {_CELLS}, fit AS (SELECT type, mean, ssw / (nt - g) / n AS v, nt - g AS df FROM cell CROSS JOIN tot)
        SELECT p.type AS a, q.type AS b, R{{p.mean - q.mean}} AS estimate, R{{sqrt(p.v + q.v)}} AS se,
               I{{p.df}} AS df, R{{(p.mean - q.mean) / sqrt(p.v + q.v)}} AS t
        FROM fit p JOIN fit q ON p.type < q.type""",
)
def pairwise_contrasts(v):
    return anova.pairwise_means(anova.fit_group_means(v.pairs, "y", "type"), "type")


@query("pairwise_contrasts_p")
def pairwise_contrasts_p(v):
    return anova.pairwise_means(anova.fit_group_means(v.pairs, "y", "type"), "type", p=True)


@query(
    "paired_ttest",
    """SELECT R{avg(a - b)} AS mean_diff, I{count(a - b)} AS n, I{count(a - b) - 1} AS df,
              R{avg(a - b) * sqrt(count(a - b)) / stddev_samp(a - b)} AS t FROM pairs""",
)
def paired_ttest(v):
    return ols.paired_ttest(v.pairs, "a", "b")


@query("paired_ttest_p")
def paired_ttest_p(v):
    return ols.paired_ttest(v.pairs, "a", "b", by=["type"], p=True)


@query("lr_r2", "SELECT type, I{regr_count(y, x)} AS n, R{regr_r2(y, x)} AS r2_lr FROM pairs GROUP BY type")
def lr_r2(v):
    return ols.lr_r2(v.pairs, "y", "x", by=["type"])


@query(
    "obs_vs_pred",
    """WITH obs AS (SELECT date, hr, avg(te) AS o FROM envlog WHERE type = 'AO' GROUP BY date, hr),
       pred AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 17 + 5 AS INTEGER) AS hr,
                       o_totalprice / 10000.0 AS p FROM orders),
       both_t AS (SELECT o, p FROM obs JOIN pred USING (date, hr))
       SELECT I{regr_count(o, p)} AS n, R{regr_slope(o, p)} AS slope, R{regr_intercept(o, p)} AS intercept,
              R{regr_r2(o, p)} AS r2, R{avg(o - p)} AS bias, R{sqrt(avg((o - p) * (o - p)))} AS rmse FROM both_t""",
)
def obs_vs_pred(v):
    return ols.obs_vs_pred(observed_predicted(v), "temp_observed", "temp_predicted")


@query(
    "residual_summary",
    """WITH fit AS (SELECT type, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pairs GROUP BY type),
       res AS (SELECT type, y - i - s * x AS r FROM pairs JOIN fit USING (type))
       SELECT type, R{quantile_cont(r, 0.0)} AS q0, R{quantile_cont(r, 0.25)} AS q25, R{quantile_cont(r, 0.5)} AS q50,
              R{quantile_cont(r, 0.75)} AS q75, R{quantile_cont(r, 1.0)} AS q100 FROM res GROUP BY type""",
)
def residual_summary(v):
    return ols.residual_summary(v.pairs, "y", "x", by=["type"])


_MODELS = {"null": [], "type": ["type"], "id": ["id"], "type_id": ["type", "id"]}


def _model_sql(name: str, keys: list[str]) -> str:
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT '{name}' AS model, sum(n) AS n, count(*) AS k, sum(ss) AS dev FROM
        (SELECT count(y) AS n, var_pop(y) * count(y) AS ss FROM pairs {group})"""


_FITS = f"""fits AS ({' UNION ALL '.join(_model_sql(m, k) for m, k in _MODELS.items())}),
    aics AS (SELECT model, n - k AS rdf, dev, n * ln(2 * pi() * dev / n) + n + 2 * (k + 1) AS aic FROM fits),
    base AS (SELECT rdf AS rdf0, dev AS dev0 FROM aics WHERE model = 'null')"""


@query(
    "model_compare",
    f"""WITH {_FITS} SELECT model, I{{rdf}} AS resid_df, R{{dev}} AS resid_dev, I{{rdf0 - rdf}} AS delta_df,
        R{{dev0 - dev}} AS delta_dev, R{{aic}} AS aic, R{{aic - min(aic) OVER ()}} AS delta_aic,
        R{{100 * (1 - dev / dev0)}} AS dev_expl FROM aics CROSS JOIN base""",
    digits=3,
)
def model_compare(v):
    fits = compare.cell_models(v.pairs, "y", _MODELS, ["type", "id"])
    return compare.model_compare(fits, "null")


@query("model_compare_p", digits=3)
def model_compare_p(v):
    fits = compare.cell_models(v.pairs, "y", _MODELS, ["type", "id"])
    return compare.model_compare(fits, "null", p=True)


@query("aicc_weights", f"WITH {SURV_MODELS.replace('sex', 'grp')} SELECT model, {WEIGHTS} FROM lik")
def aicc_weights(v):
    return compare.aicc_weights(survival.survival_models(v.survlog, "survived", "grp"))


@query(
    "survival_rate",
    f"""SELECT grp, sex, I{{n}} AS n, I{{s}} AS survivors, R{{s / n}} AS rate, R{{{DEV}}} AS deviance
        FROM (SELECT grp, sex, CAST(count(*) AS DOUBLE) AS n,
                     CAST(sum(CASE WHEN survived THEN 1 ELSE 0 END) AS DOUBLE) AS s
              FROM survlog GROUP BY grp, sex)""",
)
def survival_rate(v):
    return survival.survival_rate(v.survlog, "survived", ["grp", "sex"])


# Newton steps written out, each one pass over the trials.
_SINE_STEPS = 12
_LOGIT_STEPS = 8


def _sine_sql() -> str:
    ctes = ["b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b)"]
    for i in range(_SINE_STEPS):
        ctes.append(
            f"""b{i + 1} AS (SELECT any_value(b) + sum(trait * (y - (sin(b * trait) + 1) / 2) * 2 / cos(b * trait))
                / sum(trait * trait) AS b FROM trial CROSS JOIN b{i})"""
        )
    return (
        "WITH trial AS (SELECT trait, CASE WHEN survived THEN 1.0 ELSE 0.0 END AS y FROM survlog), "
        + ", ".join(ctes)
        + f""", info AS (SELECT any_value(b) AS b, sum(trait * trait * (1 - 2 * (y - (sin(b * trait) + 1) / 2)
                * sin(b * trait) / (cos(b * trait) * cos(b * trait)))) AS i FROM trial CROSS JOIN b{_SINE_STEPS})
            SELECT 'trait' AS term, R{{b}} AS estimate, R{{1 / sqrt(i)}} AS se FROM info"""
    )


def _logit_ctes() -> str:
    ctes = ["b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b0, CAST(0.0 AS DOUBLE) AS b1)"]
    mu = "(1 / (1 + exp(-(b0 + b1 * trait))))"
    for i in range(_LOGIT_STEPS):
        ctes.append(
            f"""m{i} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(y - {mu}) AS u0,
                sum((y - {mu}) * trait) AS u1, sum({mu} * (1 - {mu})) AS i00,
                sum({mu} * (1 - {mu}) * trait) AS i01, sum({mu} * (1 - {mu}) * trait * trait) AS i11
                FROM trial CROSS JOIN b{i}),
            b{i + 1} AS (SELECT b0 + (i11 * u0 - i01 * u1) / (i00 * i11 - i01 * i01) AS b0,
                b1 + (i00 * u1 - i01 * u0) / (i00 * i11 - i01 * i01) AS b1 FROM m{i})"""
        )
    last = _LOGIT_STEPS
    ctes.append(
        f"""info AS (SELECT sum({mu} * (1 - {mu})) AS i00, sum({mu} * (1 - {mu}) * trait) AS i01,
            sum({mu} * (1 - {mu}) * trait * trait) AS i11 FROM trial CROSS JOIN b{last}),
        fit AS (SELECT b0, b1, i11 / (i00 * i11 - i01 * i01) AS v00, -i01 / (i00 * i11 - i01 * i01) AS v01,
            i00 / (i00 * i11 - i01 * i01) AS v11 FROM b{last} CROSS JOIN info)"""
    )
    return (
        "WITH trial AS (SELECT trait, CASE WHEN survived THEN 1.0 ELSE 0.0 END AS y FROM survlog), "
        + ", ".join(ctes)
    )


def _line_terms():
    return {"intercept": F.lit(1.0), "trait": F.col("trait")}


@query(
    "survival_glm",
    _logit_ctes()
    + """ SELECT 'intercept' AS term, R{b0} AS estimate, R{sqrt(v00)} AS se FROM fit
          UNION ALL SELECT 'trait', R{b1}, R{sqrt(v11)} FROM fit""",
)
def survival_glm(v):
    return survival.survival_glm(v.survlog, "survived", _line_terms()).tables(v.spark)["coefficients"]


# One term for each sex: the penalised estimate adds half a survivor and half a death to each.
@query(
    "survival_penalised",
    """WITH c AS (SELECT sex, count(*) + 1.0 AS n, sum(CASE WHEN survived THEN 1 ELSE 0 END) + 0.5 AS s
                  FROM survlog WHERE survived IS NOT NULL AND sex IN ('ZWf', 'ZZm') GROUP BY sex)
       SELECT sex AS term, R{ln(s / (n - s))} AS estimate,
              R{sqrt(1 / ((n - 1) * (s / n) * (1 - s / n)))} AS se FROM c""",
)
def survival_penalised(v):
    rows = v.survlog.filter(F.col("sex").isin("ZWf", "ZZm"))
    terms = {sex: F.when(F.col("sex") == sex, 1.0).otherwise(0.0) for sex in ("ZWf", "ZZm")}
    return survival.survival_penalised(rows, "survived", terms).tables(v.spark)["coefficients"]


@query("survival_glm_sine", _sine_sql())
def survival_glm_sine(v):
    fit = survival.survival_glm(v.survlog, "survived", {"trait": F.col("trait")}, link="sine")
    return fit.tables(v.spark)["coefficients"]


@query("survival_glm_optima")
def survival_glm_optima(v):
    fits = survival.survival_optima(
        v.survlog, "survived", "trait", F.col("trait"), [-12.0, -6.0, 0.0, 6.0, 12.0]
    )
    rows = [(float(f.coef[0]), float(f.deviance)) for f in fits]
    return v.spark.createDataFrame(rows, "estimate double, deviance double")


@query("survival_glm_by_sex")
def survival_glm_by_sex(v):
    terms = _line_terms() | {"male": F.when(F.col("sex") == "ZZm", 1.0).otherwise(0.0)}
    fit = survival.survival_glm(v.survlog, "survived", terms)
    return fit.tables(v.spark)["summary"]


@query(
    "survival_curve",
    _logit_ctes()
    + """, span AS (SELECT sex, min(trait) AS lo, max(trait) AS hi FROM survlog GROUP BY sex),
         grid AS (SELECT sex, lo + (hi - lo) * i / 100.0 AS x FROM span CROSS JOIN (SELECT unnest(range(101)) AS i)),
         eta AS (SELECT sex, x, b0 + b1 * x AS e, sqrt(v00 + 2 * x * v01 + x * x * v11) AS w FROM grid CROSS JOIN fit)
         SELECT sex, R{x} AS trait, R{1 / (1 + exp(-e))} AS survival,
                R{w * (1 / (1 + exp(-e))) * (1 - 1 / (1 + exp(-e)))} AS se,
                R{1 / (1 + exp(-(e - 1.959963984540054 * w)))} AS lci,
                R{1 / (1 + exp(-(e + 1.959963984540054 * w)))} AS uci FROM eta""",
)
def survival_curve(v):
    fit = survival.survival_glm(v.survlog, "survived", _line_terms())
    span = v.survlog.groupBy("sex").agg(F.min("trait").alias("lo"), F.max("trait").alias("hi"))
    step = F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 100.0
    grid = span.select("*", step).select("sex", at.alias("trait"))
    return survival.survival_curve(grid, fit, _line_terms())


# ---- mixed and additive models ---------------------------------------------

FACTORS = {"sex": ["ZWf", "ZZm"], "season": list(SEASONS)}
BOTH = [("season", "sex")]


def _intercept_fit(v):
    rows = mixed.listed_rows(v.seasonlog, FACTORS)
    return mixed.fit_random_intercept(rows, "tsurf", FACTORS, interactions=BOTH)


@query(
    "fit_random_intercept_cells",
    """SELECT id, sex, season, I{count(tsurf)} AS n, R{avg(tsurf)} AS mean, R{var_pop(tsurf) * count(tsurf)} AS ss
       FROM seasonlog WHERE sex <> 'ZZf' GROUP BY id, sex, season""",
)
def fit_random_intercept_cells(v):
    rows = v.seasonlog.filter(F.col("sex").isin(*FACTORS["sex"]))
    return mixed.model_cells(rows, "tsurf", ["id", "sex", "season"])


# y ~ 1 + (1 | id): the criterion on a coarse grid, then on one far finer than the search of the fit.
def _reml_steps(rho: str, tag: str) -> str:
    return f"""sums{tag} AS (SELECT theta, r, sum(n) AS nn, count(*) AS g, sum(n) - sum(n * n / (n + r)) AS h,
        sum(s) - sum(n * s / (n + r)) AS u, sum(q) - sum(s * s / (n + r)) AS z, sum(ln(n + r)) AS ld
        FROM ind CROSS JOIN {rho} GROUP BY theta, r),
    crit{tag} AS (SELECT *, 25 + u / h AS mu, (z - u * u / h) / (nn - 1) AS s2,
        (nn - 1) * ln((z - u * u / h) / (nn - 1)) + ld + ln(h) - g * ln(r) AS c FROM sums{tag}),
    best{tag} AS (SELECT * FROM crit{tag} ORDER BY c LIMIT 1)"""


_REML_NULL = f"""WITH ind AS (SELECT id, CAST(count(*) AS DOUBLE) AS n, sum(tsurf - 25) AS s,
        sum((tsurf - 25) * (tsurf - 25)) AS q FROM seasonlog WHERE sex <> 'ZZf' GROUP BY id),
    rho AS (SELECT i / 64.0 AS theta, pow(10, i / 64.0) AS r FROM (SELECT unnest(range(-256, 577)) AS i)),
    {_reml_steps('rho', '0')},
    fine AS (SELECT theta + j / 100000.0 AS theta, pow(10, theta + j / 100000.0) AS r
        FROM best0 CROSS JOIN (SELECT unnest(range(-2000, 2001)) AS j)),
    {_reml_steps('fine', '1')}
    SELECT R{{mu}} AS mean, R{{sqrt(s2 / h)}} AS se, R{{s2}} AS sigma2,
        R{{CASE WHEN theta < {mixed.NO_VARIANCE} THEN s2 / r ELSE 0 END}} AS var_id FROM best1"""


@query("fit_random_intercept_null", _REML_NULL, digits=3)
def fit_random_intercept_null(v):
    rows = v.seasonlog.filter(F.col("sex").isin(*FACTORS["sex"]))
    fit = mixed.fit_random_intercept(rows, "tsurf", {})
    values = (float(fit.beta[0]), float(fit.cov[0, 0] ** 0.5), float(fit.sigma2), float(fit.var_id))
    return v.spark.createDataFrame([values], "mean double, se double, sigma2 double, var_id double")


@query("fit_random_intercept")
def fit_random_intercept(v):
    tables = _intercept_fit(v).tables(v.spark)
    coef = tables["coefficients"]
    info = tables["summary"].select(
        F.col("name").alias("term"), F.col("value").alias("estimate"), F.lit(None).cast("double").alias("se")
    )
    return coef.unionByName(info)


@query("anova_mixed")
def anova_mixed(v):
    return mixed.anova_mixed(v.spark, _intercept_fit(v))


@query("marginal_means")
def marginal_means(v):
    return mixed.marginal_means(v.spark, _intercept_fit(v), ["season", "sex"])


@query("pairwise_marginal_means")
def pairwise_marginal_means(v):
    fit = _intercept_fit(v)
    seasons = mixed.pairwise_contrasts(v.spark, fit, "season")
    return seasons.unionByName(mixed.pairwise_contrasts(v.spark, fit, "sex", within="season"))


def _smooth_fit(v, **options):
    rows = mixed.listed_rows(v.seasonlog, FACTORS)
    return mixed.fit_smooth(rows, "ms2", "tsurf", FACTORS, BOTH, id="id", **options)


@query("fit_smooth")
def fit_smooth(v):
    return _smooth_fit(v).tables(v.spark)["coefficients"]


@query("smooth_terms")
def smooth_terms(v):
    return mixed.smooth_terms(v.spark, _smooth_fit(v))


@query("predict_fit")
def predict_fit(v):
    return mixed.predict_fit(_smooth_fit(v, id_curves=True))


@query("predict_grid_mean")
def predict_grid_mean(v):
    grid = prediction_grid(v).withColumnRenamed("temp", "tsurf")
    rows = mixed.predict_fit(_smooth_fit(v, id_curves=True), new=grid)
    return mixed.predict_grid_mean(rows, ["tsurf", "sex", "season"], x="tsurf")


@query("smooth_curve")
def smooth_curve(v):
    return mixed.smooth_curve(v.spark, _smooth_fit(v), ["sex", "season"])


@query("model_compare_smooth")
def model_compare_smooth(v):
    """The ten curve models, all of the rows with a listed sex and season."""
    rows = mixed.smooth_cells(mixed.listed_rows(v.seasonlog, FACTORS), "ms2", "tsurf", FACTORS, "id")
    sex, season = {"sex": FACTORS["sex"]}, {"season": FACTORS["season"]}
    one, own = {"id": "id"}, {"id": "id", "id_curves": True}
    models = {
        "temp": ({}, (), {}),
        "temp_id": ({}, (), own),
        "sex": (sex, (), {"by": "sex", **one}),
        "sex_id": (sex, (), own),
        "season": (season, (), {"by": "season", **one}),
        "season_id": (season, (), own),
        "season_sex": (FACTORS, (), one),
        "season_sex_id": (FACTORS, (), own),
        "season_sex_interaction": (FACTORS, BOTH, one),
        "season_sex_interaction_id": (FACTORS, BOTH, own),
    }
    fits = {
        name: mixed.fit_smooth(rows, "ms2", "tsurf", factors, both, **options)
        for name, (factors, both, options) in models.items()
    }
    return compare.model_compare(mixed.fits_table(v.spark, fits), "temp", "null_dev", p=True)


# ---- tables over several models --------------------------------------------


def effectiveness_fit(v):
    """Effectiveness index by sex and season with individuals as random."""
    e = effectiveness.effectiveness(field.deviations(with_tb(v.seasonlog)), quality(v))
    rows = mixed.listed_rows(e, FACTORS)
    return mixed.fit_random_intercept(rows, "e_index", FACTORS, interactions=BOTH)


@query("effectiveness_effects")
def effectiveness_effects(v):
    return tables.effects_table(v.spark, {"E": effectiveness_fit(v)})


@query("effectiveness_contrasts")
def effectiveness_contrasts(v):
    return tables.contrast_table(v.spark, effectiveness_fit(v), "sex", within="season")


@query("activity_effects")
def activity_effects(v):
    """Minutes moved per hour by sex and season, with and without their interaction."""
    act = mixed.listed_rows(aggregate.activity_by_id(minutes(v)), FACTORS)
    fits = {
        name: mixed.fit_random_intercept(act, "movement_hr", FACTORS, interactions=both)
        for name, both in (("interaction", BOTH), ("main", ()))
    }
    return tables.effects_table(v.spark, fits)


def _optima_fits(v):
    rows = settle(mixed.listed_rows(fitted_optima(v), FACTORS))
    return {
        y: mixed.fit_random_intercept(rows, y, FACTORS, interactions=BOTH) for y in ("topt", "pmax")
    }


@query("optima_effects")
def optima_effects(v):
    return tables.effects_table(v.spark, _optima_fits(v))


@query("optima_contrasts")
def optima_contrasts(v):
    """Seasonal contrasts of the optimum and the maximum."""
    out = None
    for name, fit in _optima_fits(v).items():
        one = tables.contrast_table(v.spark, fit, "season").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("anova_table")
def anova_table(v):
    rows = mixed.listed_rows(v.seasonlog, FACTORS)
    db = aggregate.individual_db(joins.band_deviation(with_tb(rows), "tb"))
    de = quality(v).groupBy("model_id", "season", "type", "analysis").agg(F.avg("de").alias("de"))
    te_factors = {"analysis": [f"de_{s}" for s in FACTORS["sex"]], "season": FACTORS["season"]}
    fits = {
        "Tb": mixed.fit_random_intercept(db, "tb", FACTORS, interactions=BOTH),
        "db": mixed.fit_random_intercept(db, "individual_db", FACTORS, interactions=BOTH),
        "de": mixed.fit_random_intercept(
            de, "de", te_factors, id="model_id", interactions=[("season", "analysis")]
        ),
        "E": effectiveness_fit(v),
    }
    return tables.effects_table(v.spark, fits)


@query("season_means")
def season_means(v):
    """Hourly body temperature by sex beside the calibrated daylight environment."""
    hourly = mixed.listed_rows(field.accuracy(with_tb(v.seasonlog)), FACTORS)
    tb = mixed.fit_random_intercept(hourly, "tb", FACTORS, interactions=BOTH)
    env = habitat.calibrated(v.envlog, before="2001-09-01")
    by_model = env.groupBy("season", "model_id").agg(F.avg("te").alias("te"))
    te = mixed.fit_random_intercept(by_model, "te", {"season": FACTORS["season"]}, id="model_id")
    return tables.season_means(v.spark, tb, te)


@query("activity_contrasts")
def activity_contrasts(v):
    """Seasonal contrasts of log(1 + activity) per individual."""
    act = aggregate.activity_by_id(minutes(v)).withColumn("y", F.log1p("movement_hr"))
    act = mixed.listed_rows(act, FACTORS)
    fit = mixed.fit_random_intercept(act, "y", FACTORS, interactions=BOTH)
    return tables.contrast_table(v.spark, fit, "season")


@query("fitted_optima")
def fitted_optima(v):
    rows = clean.filter_category(curve(v), "sex", drop=["ZZf"])
    return performance.fitted_optima(rows, FACTORS, BOTH)
