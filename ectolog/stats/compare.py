"""Model comparison tables. Rows are models, so these tables are tiny."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ectolog.session import settle
from ectolog.stats.anova import centred, group_sums
from ectolog.stats.tails import chi2_pvalue


def _whole() -> Window:
    """The whole table as one window: as many rows as models compared."""
    return Window.partitionBy(F.lit(0))


def cell_models(
    df: DataFrame, y: str, models: Mapping[str, Sequence[str]], all_keys: Sequence[str]
) -> DataFrame:
    """Gaussian cell-mean models, each over its own subset of the keys.

    The data are read once into cells of all keys; every model is then an
    aggregate of those cells. One row per model: ``model``, ``resid_df``,
    ``resid_dev``, ``aic``.
    """
    cells = settle(group_sums(df, y, all_keys))
    out = None
    for name, keys in models.items():
        groups = centred(cells, keys).groupBy(*keys).agg(
            F.sum("n").alias("_n"),
            (F.sum("ss") + F.sum(F.col("n") * F.col("_d") * F.col("_d"))).alias("_ss"),
        )
        one = groups.agg(
            F.lit(name).alias("model"),
            F.sum("_n").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum("_ss").alias("resid_dev"),
        )
        out = one if out is None else out.unionByName(one)
    size = F.col("n").cast("double")
    aic = size * F.ln(2 * pi * F.col("resid_dev") / size) + size + 2 * (F.col("k") + 1)
    return out.select(
        "model", (F.col("n") - F.col("k")).alias("resid_df"), "resid_dev", aic.alias("aic")
    )


def model_compare(
    fits: DataFrame, base: str, null_dev: str | None = None, p: bool = False
) -> DataFrame:
    """Compare fitted models with a base model and order them by AIC.

    ``fits`` has ``model``, ``resid_df``, ``resid_dev`` and ``aic``. Without
    ``null_dev`` (a column) the base model's deviance counts as the null.
    """
    whole = _whole()
    is_base = F.col("model") == base
    base_df = F.max(F.when(is_base, F.col("resid_df"))).over(whole)
    base_dev = F.max(F.when(is_base, F.col("resid_dev"))).over(whole)
    null = base_dev if null_dev is None else F.col(null_dev)
    out = fits.select(
        "model",
        "resid_df",
        "resid_dev",
        (base_df - F.col("resid_df")).alias("delta_df"),
        (base_dev - F.col("resid_dev")).alias("delta_dev"),
        "aic",
        (F.col("aic") - F.min("aic").over(whole)).alias("delta_aic"),
        (F.lit(100.0) * (F.lit(1.0) - F.col("resid_dev") / null)).alias("dev_expl"),
    )
    if p:
        scale = F.try_divide("resid_dev", "resid_df")
        chi = F.try_divide(F.col("delta_dev"), scale)
        out = out.withColumn(
            "p",
            F.when(
                F.col("delta_df") > 0, chi2_pvalue(chi.cast("double"), F.col("delta_df").cast("double"))
            ),
        )
    return out.orderBy("aic")


def aicc_weights(models: DataFrame) -> DataFrame:
    """AICc, its difference from the best, relative likelihood and weight.

    ``models`` has ``model``, ``deviance``, ``k`` and ``n``.
    """
    k, n = F.col("k"), F.col("n")
    aicc = F.col("deviance") + 2 * k + F.try_divide(2 * k * (k + 1), n - k - 1)
    whole = _whole()
    return (
        models.withColumn("aicc", aicc)
        .withColumn("delta_aicc", F.col("aicc") - F.min("aicc").over(whole))
        .withColumn("likelihood", F.exp(-F.col("delta_aicc") / 2))
        .withColumn("weight", F.col("likelihood") / F.sum("likelihood").over(whole))
        .select("model", "aicc", "delta_aicc", "weight", "likelihood", "k", "deviance")
    )
