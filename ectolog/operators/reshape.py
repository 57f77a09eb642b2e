"""Arg-max, group spread and wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.operators.joins import attach
from ectolog.stats.tails import t_quantile


def argmax_first(
    df: DataFrame, keys: Sequence[str], value: str, tie_break: Sequence[str]
) -> DataFrame:
    """The row of the largest value per group; ties go to the smallest tie-break.

    An aggregate of whole rows (partially combined before the shuffle), not a
    row number over a sorted group.
    """
    rest = [c for c in df.columns if c not in keys]
    others = [c for c in rest if c != value and c not in tie_break]
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys,
        F.struct(
            (-F.col(value)).alias("_neg"),
            *[F.col(c) for c in tie_break],
            *[F.col(c) for c in others],
        ).alias("_row"),
    )
    best = rows.groupBy(*keys).agg(F.min("_row").alias("_row"))
    return best.select(
        *keys,
        *[
            (-F.col("_row._neg")).alias(c) if c == value else F.col(f"_row.{c}").alias(c)
            for c in rest
        ],
    )


def argmax_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every row that equals its group's largest value.

    The maxima are joined back on (keys, value), which spreads a large group
    by value and matches nothing but the tied rows.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    top = rows.groupBy(*keys).agg(F.max(value).alias(value))
    return attach(rows, top, [*keys, value], "left_semi", null_safe=True)


def topt_pmax(
    df: DataFrame,
    keys: Sequence[str] = ("id", "sex", "season"),
    fit: str = "fit",
    tb: str = "tb",
    digits: int = 9,
) -> DataFrame:
    """Optimum temperature and maximum per group: means over the tied arg-max rows.

    Rows are first combined per (group, fitted value), so both steps are
    plain aggregates. Fitted values that agree to ``digits`` decimals are
    tied: the last bits of a computed fit depend on the order of summation.
    """
    rows = df.filter(F.col(fit).isNotNull() & ~F.isnan(fit))
    rows = rows.withColumn(fit, F.round(fit, digits))
    levels = rows.groupBy(*keys, fit).agg(F.sum(tb).alias("_s"), F.count(tb).alias("_n"))
    best = levels.groupBy(*keys).agg(
        F.max_by(F.struct("_s", "_n"), F.col(fit)).alias("_b"), F.max(fit).alias("pmax")
    )
    return best.select(*keys, F.try_divide("_b._s", "_b._n").alias("topt"), "pmax")


def group_ci(
    df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95, ci: bool = True
) -> DataFrame:
    """Per-row interval from the spread of the whole group.

    The group's deviation and size are aggregated and attached, rather than
    computed over a window that would hold the group in one task.
    """
    spread = df.groupBy(*keys).agg(
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.count(F.lit(1)).alias("_n"),
    )
    if ci:
        spread = spread.withColumn(
            "_t", t_quantile(F.lit(0.5 + level / 2), (F.col("_n") - 1).cast("double"))
        )
    out = attach(df, spread, keys, null_safe=True)
    if ci:
        out = out.withColumns(
            {
                "lower_ci": F.col(value) - F.col("_t") * F.col("se"),
                "upper_ci": F.col(value) + F.col("_t") * F.col("se"),
            }
        ).drop("_t")
    return out.drop("_n")


def pivot_wide(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    levels: Sequence[str],
    values: Mapping[str, str],
) -> DataFrame:
    """One column per (value, level). The levels are listed, so no extra scan.

    ``values`` maps a column to the prefix of its wide columns.
    """
    wide = df.groupBy(*keys).pivot(names_from, list(levels)).agg(
        *[F.max(c).alias(prefix) for c, prefix in values.items()]
    )
    if len(values) == 1:
        prefix = next(iter(values.values()))
        return wide.withColumnsRenamed({lv: f"{prefix}_{lv}" for lv in levels})
    return wide.withColumnsRenamed(
        {f"{lv}_{prefix}": f"{prefix}_{lv}" for lv in levels for prefix in values.values()}
    )
