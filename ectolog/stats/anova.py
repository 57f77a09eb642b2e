"""One-factor models from group sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.operators.joins import null_safe_join
from ectolog.session import settle
from ectolog.stats.tails import f_pvalue, tukey_pvalue


def group_sums(df: DataFrame, y: str, keys: Sequence[str]) -> DataFrame:
    """Count, mean and centred sum of squares per cell."""
    return df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(y)).alias("ss"),
    )


def centred(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells with ``_d``, the distance of their mean from the common mean of their ``by`` group.

    Sums of squares are taken of these distances: the difference of two large
    sums would lose the digits that matter when the mean is far from 0.
    """
    common = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m")
    if by:
        rows = null_safe_join(cells, cells.groupBy(*by).agg(common), by, "inner")
    else:
        rows = cells.withColumn("_m", cells.agg(common).scalar())
    return rows.withColumn("_d", F.col("mean") - F.col("_m")).drop("_m")


def _totals(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of computed cells: groups, n, sums of squares within and between."""
    return centred(cells, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n_total"),
        F.sum("ss").alias("ss_within"),
        F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("ss_between"),
    )


def fit_group_means(df: DataFrame, y: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Group means with the common (pooled) standard error."""
    # One row per level: computed once, then read for the rows and the pool.
    cells = settle(group_sums(df, y, [*by, group]))
    free = F.col("n_total") - F.col("groups")
    pooled = _totals(cells, by).select(
        *by,
        F.struct(
            F.try_divide("ss_within", F.nullif(free, F.lit(0))).alias("v"), free.alias("df")
        ).alias("_p"),
    )
    if by:
        rows = null_safe_join(cells, pooled, by, "inner")
    else:
        rows = cells.withColumn("_p", pooled.scalar())
    se = F.sqrt(F.col("_p.v") / F.col("n")).alias("se")
    return rows.select(*by, group, "n", "mean", se, F.col("_p.df").alias("df"))


def anova_oneway(
    df: DataFrame, y: str, group: str, by: Sequence[str] = (), p: bool = False
) -> DataFrame:
    """Sums of squares, degrees of freedom and F of ``y ~ group``."""
    t = _totals(settle(group_sums(df, y, [*by, group])), by)
    out = t.select(
        *by,
        (F.col("groups") - 1).alias("df1"),
        (F.col("n_total") - F.col("groups")).alias("df2"),
        "ss_between",
        "ss_within",
    )
    ms1 = F.try_divide("ss_between", F.nullif(F.col("df1"), F.lit(0)))
    ms2 = F.try_divide("ss_within", F.nullif(F.col("df2"), F.lit(0)))
    out = out.withColumn("f", F.try_divide(ms1, ms2))
    if p:
        d1, d2 = F.col("df1").cast("double"), F.col("df2").cast("double")
        out = out.withColumn("p", f_pvalue("f", d1, d2))
    return out


def anova_regression(df: DataFrame, y: str, x: str, p: bool = False) -> DataFrame:
    """Sums of squares and F of the straight line ``y ~ x``."""
    t = df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_syy(y, x).alias("_syy"),
        (F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("ss_model"),
    ).select(
        F.lit(1).cast("long").alias("df1"),
        (F.col("n") - 2).alias("df2"),
        "ss_model",
        (F.col("_syy") - F.col("ss_model")).alias("ss_residual"),
    )
    ms2 = F.try_divide("ss_residual", F.nullif(F.col("df2"), F.lit(0)))
    out = t.withColumn("f", F.try_divide(F.col("ss_model"), ms2))
    if p:
        d1, d2 = F.col("df1").cast("double"), F.col("df2").cast("double")
        out = out.withColumn("p", f_pvalue("f", d1, d2))
    return out


#: Levels of a factor whose pairs are listed (half a million pairs).
MAX_LEVELS = 1000


def pairwise_means(
    means: DataFrame, group: str, p: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """All pairs of :func:`fit_group_means` rows, Tukey-adjusted, within each ``by`` group.

    The rows are the levels of one factor, so the self-join is of a summary;
    more than ``MAX_LEVELS`` levels raise.
    """
    means = settle(means)
    most = means.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_LEVELS:
        raise ValueError(f"{most} levels of {group} have too many pairs (at most {MAX_LEVELS})")
    if by:
        return _pairs_within(means, group, p, by)
    a = means.select(F.col(group).alias("a"), F.col("mean").alias("_ma"), F.col("n").alias("_na"),
                     F.col("se").alias("_sa"), "df")
    b = means.select(F.col(group).alias("b"), F.col("mean").alias("_mb"), F.col("n").alias("_nb"),
                     F.col("se").alias("_sb"), F.col("df"))
    out = a.join(b, ["df"]).filter(F.col("a") < F.col("b")).select(
        "a",
        "b",
        (F.col("_ma") - F.col("_mb")).alias("estimate"),
        F.sqrt(F.col("_sa") ** 2 + F.col("_sb") ** 2).alias("se"),
        "df",
    ).withColumn("t", F.try_divide("estimate", "se"))
    if p:
        levels = F.lit(float(most))
        q = F.abs("t") * F.sqrt(F.lit(2.0))
        out = out.withColumn("p", tukey_pvalue(q, levels, F.col("df").cast("double")))
    return out


def _pairs_within(means: DataFrame, group: str, p: bool, by: Sequence[str]) -> DataFrame:
    """Pairs of levels that stand in the same ``by`` group; the group's own levels count."""
    level = F.struct(F.col(group).alias("g"), "mean", "se")
    rows = means.groupBy(*by, "df").agg(F.sort_array(F.collect_list(level)).alias("_all"))
    rows = rows.withColumn("_k", F.size("_all").cast("double"))
    rows = rows.select("*", F.explode("_all").alias("_a")).select("*", F.explode("_all").alias("_b"))
    rows = rows.where(F.col("_a.g") < F.col("_b.g"))
    out = rows.select(
        *by,
        F.col("_a.g").alias("a"),
        F.col("_b.g").alias("b"),
        (F.col("_a.mean") - F.col("_b.mean")).alias("estimate"),
        F.sqrt(F.col("_a.se") ** 2 + F.col("_b.se") ** 2).alias("se"),
        "df",
        "_k",
    ).withColumn("t", F.try_divide("estimate", "se"))
    if p:
        q = F.abs("t") * F.sqrt(F.lit(2.0))
        out = out.withColumn("p", tukey_pvalue(q, F.col("_k"), F.col("df").cast("double")))
    return out.drop("_k")
