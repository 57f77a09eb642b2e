"""Effectiveness of thermoregulation by individual, season and sex."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.functions import SEASONS, effectiveness_index, round_half_even
from ectolog.operators import aggregate
from ectolog.operators.joins import PUBLISHED_BANDS


def effectiveness(
    deviations: DataFrame,
    quality: DataFrame,
    decimals: int | None = None,
    sexes: Sequence[str] = tuple(PUBLISHED_BANDS),
    seasons: Sequence[str] = SEASONS,
) -> DataFrame:
    """``E = 1 - db/de`` with the season's mean habitat deviation of the same sex.

    ``deviations`` has (id, season, sex, db), ``quality`` (analysis, season,
    de). ``decimals`` rounds the seasonal means first, as published.
    """
    sex = F.expr("substring(analysis, 4)")
    known = quality.filter(sex.isin(*sexes) & F.col("season").isin(*seasons))
    de = aggregate.grand_mean_de(known)
    if decimals is not None:
        de = de.withColumn("de_season", round_half_even(F.col("de_season"), decimals))
    de = de.select(sex.alias("sex"), F.col("season"), F.col("de_season"))
    db = aggregate.season_db(deviations)
    # Grouped by listed labels: at most len(sexes) * len(seasons) rows.
    joined = db.join(F.broadcast(de), ["sex", "season"])
    return joined.withColumn(
        "e_index", effectiveness_index(F.col("db_mean"), F.col("de_season"))
    )
