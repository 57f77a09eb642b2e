"""Summary tables over several fitted models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.functions import p_label, round_half_even
from ectolog.stats import mixed


def effects_table(spark: SparkSession, fits: Mapping[str, mixed.Fit], digits: int = 2) -> DataFrame:
    """Effects of every model stacked, F rounded, p as a label."""
    out = None
    for name, fit in fits.items():
        one = mixed.anova_mixed(spark, fit).select(
            F.lit(name).alias("model"),
            "effect",
            "df1",
            "df2",
            round_half_even(F.col("f"), digits).alias("f"),
            p_label(F.col("p")).alias("p"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def season_means(spark: SparkSession, tb: mixed.Fit, te: mixed.Fit) -> DataFrame:
    """Marginal means of body temperature by sex beside environment temperature."""
    body = mixed.marginal_means(spark, tb, ["season", "sex"])
    env = mixed.marginal_means(spark, te, ["season"]).withColumn("sex", F.lit("Te"))
    return env.unionByName(body)


def contrast_table(
    spark: SparkSession, fit: mixed.Fit, over: str, within: str | None = None, digits: int = 2
) -> DataFrame:
    """Tukey-adjusted contrasts, rounded, p as a label."""
    table = mixed.pairwise_contrasts(spark, fit, over, within)
    rounded = {c: round_half_even(F.col(c), digits) for c in ("estimate", "se", "z")}
    return table.withColumns(rounded).withColumn("p", p_label(F.col("p")))
