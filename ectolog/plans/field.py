"""Field log to body temperature and movement, and thermoregulation accuracy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.functions import (
    SKIN_TO_BODY,
    calibrate_linear,
    in_range_flag,
    month_name,
    movement_vector,
)
from ectolog.operators import aggregate, clean, joins


def field_tb(
    log: DataFrame,
    until: str | None = "2019-09-01",
    min_days: int = 7,
    line: tuple[float, float] = SKIN_TO_BODY,
) -> DataFrame:
    """Daylight rows of well-tracked individuals with body temperature and movement."""
    day = clean.filter_hours(clean.filter_dates(log, until=until))
    kept = joins.keep_min_days(day, min_days)
    return clean.derive_cols(
        kept,
        {
            "tb": calibrate_linear(F.col("tsurf"), *line),
            "ms2": movement_vector(F.col("x_ms2"), F.col("y_ms2")),
        },
    )


def deviations(
    tb: DataFrame,
    bands: Mapping[str, joins.Band] = joins.PUBLISHED_BANDS,
    lo_origin: Mapping[str, float] | None = None,
    grain: str = "hour",
) -> DataFrame:
    """Body temperature per (individual, date, hour) with its set-point deviation.

    ``grain="day"`` repeats the daily mean for each hour of the day (the
    published form); ``"hour"`` uses hourly means.
    """
    known = tb.filter(F.col("sex").isin(*bands))
    if grain == "day":
        hourly = aggregate.replicate_unique(known)
    else:
        known = aggregate.dealt(known, ["id", "date", "hr"])
        hourly = known.groupBy("id", "date", "hr", "season", "sex").agg(F.avg("tb").alias("tb"))
    out = joins.band_deviation(hourly, "tb", bands, lo_origin=lo_origin)
    return out.withColumn("ex", in_range_flag(F.col("db")))


def accuracy(tb: DataFrame, grain: str = "hour", **options) -> DataFrame:
    """Mean deviation per individual, date and hour, with the month name."""
    db = aggregate.individual_db(deviations(tb, grain=grain, **options))
    return db.withColumn("month", month_name(F.col("date")))
