"""Simple regression and paired comparisons from one pass of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.operators.joins import attach
from ectolog.operators.quantiles import five_number
from ectolog.stats.tails import t_pvalue, t_quantile


def fit_ols(df: DataFrame, y: str, x: str, by: Sequence[str] = (), p: bool = False) -> DataFrame:
    """``y = intercept + slope x``: coefficients, errors, t values and fit.

    One row per group of ``by`` (one row in all without it). ``p`` adds
    two-sided p values.
    """
    sums = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_min"),
        F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_max"),
    )
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma = F.sqrt(F.try_divide(rss, F.nullif(F.col("n") - 2, F.lit(0))))
    at_zero = F.lit(1.0) / F.col("n") + F.try_divide(F.col("x_mean") ** 2, F.col("sxx"))
    out = (
        sums.withColumn("sigma", sigma)
        .withColumn("se_slope", F.try_divide("sigma", F.sqrt("sxx")))
        .withColumn("se_intercept", F.col("sigma") * F.sqrt(at_zero))
        .withColumn("t_slope", F.try_divide("slope", "se_slope"))
        .withColumn("t_intercept", F.try_divide("intercept", "se_intercept"))
        .drop("syy", "sxy")
    )
    if p:
        df_resid = (F.col("n") - 2).cast("double")
        out = out.withColumns(
            {f"p_{c}": t_pvalue(F.col(f"t_{c}"), df_resid) for c in ("slope", "intercept")}
        )
    return out


def ols_confint(fit: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds confidence limits of both coefficients to a :func:`fit_ols` table."""
    t = t_quantile(F.lit(0.5 + level / 2), (F.col("n") - 2).cast("double"))
    out = fit.withColumn("_t", t)
    for c in ("slope", "intercept"):
        half = F.col("_t") * F.col(f"se_{c}")
        out = out.withColumns({f"{c}_lower": F.col(c) - half, f"{c}_upper": F.col(c) + half})
    return out.drop("_t")


def lr_r2(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Likelihood-ratio R²; for a Gaussian line it equals R²."""
    sums = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_syy(y, x).alias("_null"),
        (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_slope(y, x)).alias("_rss"),
    )
    n = F.col("n").cast("double")
    ratio = n * F.ln(F.try_divide("_null", "_rss"))
    return sums.select(*by, "n", (F.lit(1.0) - F.exp(-ratio / n)).alias("r2_lr"))


def ols_band(
    df: DataFrame,
    y: str,
    x: str,
    by: Sequence[str] = (),
    steps: int = 80,
    level: float = 0.95,
    ci: bool = True,
) -> DataFrame:
    """Fitted line with its pointwise band over the x range, one line per group."""
    fit = fit_ols(df, y, x, by)
    if ci:
        t = t_quantile(F.lit(0.5 + level / 2), (F.col("n") - 2).cast("double"))
        fit = fit.withColumn("_t", t)
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i")
    grid = fit.select("*", step)
    at = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("_i") / float(steps - 1)
    away = F.try_divide((F.col("x") - F.col("x_mean")) ** 2, F.col("sxx"))
    se = F.col("sigma") * F.sqrt(F.lit(1.0) / F.col("n") + away)
    out = (
        grid.withColumn("x", at)
        .withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("se", se)
    )
    keep = [*by, "x", "fit", "se"]
    if ci:
        half = F.col("_t") * F.col("se")
        out = out.withColumns({"lower": F.col("fit") - half, "upper": F.col("fit") + half})
        keep += ["lower", "upper"]
    return out.select(*keep)


def paired_ttest(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), p: bool = False
) -> DataFrame:
    """Paired t test of ``a - b``."""
    d = F.col(a) - F.col(b)
    out = (
        df.groupBy(*by)
        .agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"), F.count(d).alias("n"))
        .withColumn("df", F.col("n") - 1)
        .withColumn("t", F.try_divide(F.col("mean_diff") * F.sqrt("n"), F.col("_sd")))
        .drop("_sd")
    )
    return out.withColumn("p", t_pvalue("t", F.col("df").cast("double"))) if p else out


def obs_vs_pred(
    df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Agreement with the 1:1 line: regression, bias and root mean square error."""
    d = F.col(observed) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.regr_count(observed, predicted).alias("n"),
        F.regr_slope(observed, predicted).alias("slope"),
        F.regr_intercept(observed, predicted).alias("intercept"),
        F.regr_r2(observed, predicted).alias("r2"),
        F.avg(d).alias("bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
    )


def residuals(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row with the residual from its (group's) regression line."""
    fit = fit_ols(df, y, x, by).select(*by, "intercept", "slope")
    if by:
        joined = attach(df, fit, list(by), null_safe=True)
        line = F.col("intercept") + F.col("slope") * F.col(x)
        return joined.withColumn("residual", F.col(y) - line).drop("intercept", "slope")
    line = fit.select(F.struct("intercept", "slope")).scalar()
    return df.withColumn("_f", line).withColumn(
        "residual", F.col(y) - F.col("_f.intercept") - F.col("_f.slope") * F.col(x)
    ).drop("_f")


def residual_summary(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Quantile table of the residuals."""
    return five_number(residuals(df, y, x, by), "residual", by)


