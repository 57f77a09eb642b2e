"""Quantile sketches that are kept: made once per hour, merged to any coarser grain later.

A KLL sketch is a binary column of bounded size. Sketches of hours are stored with
their snapshot; those of a season, an individual or a year come from merging them,
without the readings. The rank of a merged quantile is off by at most
``rank_error(k)`` of the readings, at 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: about 2k values are held.
SIZE = 200


def rank_error(size: int = SIZE) -> float:
    """Normalised rank error of one quantile, as published for KLL sketches."""
    return 2.296 / size**0.9021


def _clean(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """``keys``, ``sketch``, ``n``: one sketch a group; NULL and NaN don't count."""
    kept = df.select(*keys, _clean(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    return kept.groupBy(*keys).agg(
        F.kll_sketch_agg_double("_v", size).alias("sketch"), F.count("_v").alias("n")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of a coarser grain from those of a finer one."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")
    )


def sketched_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """A column for each of ``probs`` from the sketch of a row."""
    return sketches.withColumns(
        {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in probs.items()}
    )


def off_by(df: DataFrame, keys: Sequence[str], value: str, quantiles: DataFrame, name: str, p: float) -> DataFrame:
    """``keys``, ``off``: how far the rank of ``name`` is from ``p``, counted over the readings.

    A value that repeats takes a range of ranks; the nearest of them counts.
    """
    rows = df.select(*keys, _clean(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    both = rows.join(quantiles.select(*keys, F.col(name).alias("_q")), list(keys))
    share = lambda held: F.sum(held.cast("long")) / F.count(F.lit(1))
    ranks = both.groupBy(*keys).agg(
        share(F.col("_v") < F.col("_q")).alias("_low"), share(F.col("_v") <= F.col("_q")).alias("_high")
    )
    off = F.greatest(F.col("_low") - F.lit(p), F.lit(p) - F.col("_high"), F.lit(0.0))
    return ranks.select(*keys, off.alias("off"))
