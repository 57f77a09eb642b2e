"""Environment models to habitat quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.functions import (
    MODEL_TO_CARCASS,
    calibrate_linear,
    in_range_flag,
    month_name,
    round_half_even,
    setpoint_deviation,
)
from ectolog.operators import clean, joins


def calibrated(
    env: DataFrame,
    before: str | None = "2019-09-01",
    line: tuple[float, float] = MODEL_TO_CARCASS,
    digits: int = 2,
) -> DataFrame:
    """Daylight model temperatures on the carcass scale."""
    day = clean.filter_hours(clean.filter_dates(env, before=before))
    te = round_half_even(calibrate_linear(F.col("te"), *line), digits)
    return day.withColumn("te", te)


def habitat(
    env: DataFrame,
    before: str | None = "2019-09-01",
    bands: Mapping[str, joins.Band] = joins.PUBLISHED_BANDS,
    lo_origin: Mapping[str, float] | None = None,
) -> DataFrame:
    """Calibrated temperature, deviation and in-range share for every band.

    Every band's means are taken in one aggregation of the readings; the rows
    are turned into one per band only after they have been reduced.
    """
    rows = calibrated(env, before)
    origins = lo_origin or {}
    aggs = []
    for i, (name, (lo, hi)) in enumerate(bands.items()):
        dev = setpoint_deviation(F.col("te"), lo, hi, origins.get(name))
        aggs += [F.avg(dev).alias(f"_de{i}"), F.avg(in_range_flag(dev)).alias(f"_ex{i}")]
    keys = ["date", "type", "model_id", "hr", "season"]
    wide = rows.groupBy(*keys).agg(F.avg("te").alias("_te"), *aggs)
    each = F.array(
        *[
            F.struct(
                F.lit(f"de_{name}").alias("analysis"),
                F.col(f"_de{i}").alias("de"),
                F.col(f"_ex{i}").alias("ex"),
            )
            for i, name in enumerate(bands)
        ]
    )
    long = wide.select(*keys, F.col("_te").alias("te"), F.explode(each).alias("_b"))
    return long.select(*keys, "_b.analysis", "te", "_b.de", "_b.ex").withColumn(
        "month", month_name(F.col("date"))
    )
