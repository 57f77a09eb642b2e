"""Performance curves from field movement and their optima."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.operators import clean, quantiles, reshape
from ectolog.stats import mixed


def binned_curve(
    tb: DataFrame,
    keys: tuple[str, ...] = ("id", "hr", "date", "month", "sex", "season"),
    drop: tuple[str, ...] = ("ZZf",),
) -> DataFrame:
    """Model-free curve: p95 of movement per whole degree, season and sex."""
    hourly = quantiles.p95_hourly(clean.filter_category(tb, "sex", drop=drop), keys=keys)
    return quantiles.p95_binned(hourly)


def performance(curve: DataFrame) -> DataFrame:
    """Optimum temperature and maximum per individual, season and sex."""
    return reshape.topt_pmax(curve, fit="p95")


def fitted_optima(
    curve: DataFrame,
    factors: Mapping[str, Sequence[str]],
    interactions: Sequence[tuple[str, ...]] = (("season", "sex"),),
    y: str = "p95",
    x: str = "temp",
) -> DataFrame:
    """Optimum and maximum from an additive model with a curve per individual.

    The optimum is the mean body temperature of the rows with the highest fit.
    """
    fit = mixed.fit_smooth(curve, y, x, factors, interactions, id="id", id_curves=True)
    keys = ["id", x, *factors]
    tb = mixed.bin_x(curve, x).groupBy(*keys).agg(F.avg("tb").alias("tb"))
    return reshape.topt_pmax(mixed.predict_fit(fit).join(tb, keys), fit="fit", tb="tb")
