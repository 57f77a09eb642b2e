"""Activity minutes and daily activity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ectolog.operators import aggregate, clean


def activity(
    log: DataFrame, by: tuple[str, ...] = ("season", "sex", "hr"), drop: tuple[str, ...] = ("ZZf",)
) -> DataFrame:
    """Movement flags summed per hour, then averaged with a standard error."""
    kept = clean.filter_category(log, "sex", drop=drop)
    return aggregate.activity_profile(aggregate.active_minutes(kept), by)
