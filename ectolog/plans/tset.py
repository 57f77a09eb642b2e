"""Preferred temperature table by sex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.functions import level_rank, relabel
from ectolog.operators import quantiles, reshape
from ectolog.stats.anova import fit_group_means

SEXES = ("ZZf", "ZWf", "ZZm")

# Table labels of the three gradient measures, in table order.
MEASURES = {"lower": "25% quantile", "mean_tb": "Mean", "upper": "75% quantile"}


def tset_table(lab: DataFrame, temp: str = "temp") -> DataFrame:
    """Lower bound, mean and upper bound by sex: means and common SE, wide."""
    ranges = quantiles.tset_by_group(lab, temp)
    long = ranges.unpivot(["sex"], list(MEASURES), "measure", "value")
    fit = fit_group_means(long, "value", "sex", by=["measure"])
    wide = reshape.pivot_wide(fit, ["measure"], "sex", SEXES, {"mean": "mean", "se": "se"})
    rank = level_rank(F.col("measure"), tuple(MEASURES))
    return wide.orderBy(rank).withColumn("gradient_index", relabel(F.col("measure"), MEASURES)).drop("measure")
