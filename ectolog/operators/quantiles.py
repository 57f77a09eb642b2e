"""Exact interpolated quantiles that survive hot groups.

The built-in ``percentile`` gathers every distinct value of a group in one
buffer. Here a group is cut along the value axis instead:

1. count rows per (group, cell, value), partially aggregated before the
   shuffle and hashed on all three, so no task owns a whole group;
2. sum the counts per (group, cell); a group has a bounded number of cells,
   so one window per group can number them;
3. keep only the one or two cells that hold a wanted rank, and rank the
   values inside those.

The result is the same linear interpolation between order statistics
(position ``(n - 1) p``) as ``percentile`` computes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A cell is 1/4096 of an e-fold wide (0.024 %); about 3 million span all doubles.
CELLS_PER_E_FOLD = 4096
CELL_UNIT = 1000.0


def value_cell(v: Column) -> Column:
    """Non-decreasing integer map of a double: linear near 0, then logarithmic."""
    size = F.least(F.abs(v), F.lit(1e300))
    cell = F.floor(F.log1p(size * CELL_UNIT) * CELLS_PER_E_FOLD)
    # A double that is never NULL: a join on it needs no extra NULL filter, so
    # both readers of the counted table share one shuffle.
    return F.coalesce(F.signum(v) * cell, F.lit(0.0)) + F.lit(0.0)


def quantile_by(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    means: Mapping[str, Column | tuple[Column, Column]] | None = None,
    spread: bool = True,
    weight: Column | None = None,
) -> DataFrame:
    """Quantiles (name -> probability) and plain means per group.

    NULL and NaN values are left out of the quantiles; a group of nothing
    else keeps its row with NULL quantiles. ``spread=False`` uses the
    built-in aggregate and is meant for groups that are small by definition.
    ``weight`` counts rows that were already grouped by value; a mean is then
    given as its (sum, count) columns.
    """
    value = F.col(value) if isinstance(value, str) else value
    clean = F.when(~F.isnan(value), value.cast("double"))
    means = dict(means or {})
    group = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)] or [F.lit(1).alias("_g0")]
    rows = df.select(
        *group,
        clean.alias("_v"),
        (F.lit(1) if weight is None else weight).cast("long").alias("_w"),
        *[c for name, expr in means.items() for c in _parts(name, expr)],
    )
    by = [f"_g{i}" for i in range(len(group))]
    out = (_spread if spread else _builtin)(rows, by, probs, list(means))
    named = [F.col(g).alias(k) for g, k in zip(by, keys, strict=False)]
    return out.select(*named, *probs, *means)


def _parts(name: str, expr: Column | tuple[Column, Column]) -> list[Column]:
    """Sum and count columns of a mean."""
    if isinstance(expr, tuple):
        total, count = expr
    else:
        total, count = expr, F.when(expr.isNotNull(), 1).otherwise(0)
    return [total.cast("double").alias(f"_s_{name}"), count.cast("long").alias(f"_k_{name}")]


def _builtin(
    rows: DataFrame, by: list[str], probs: Mapping[str, float], means: list[str]
) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
    return (
        rows.groupBy(*by)
        .agg(
            F.percentile("_v", wanted, F.col("_w")).alias("_q"),
            *[F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_k_{m}")).alias(m) for m in means],
        )
        .select(
            *by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)], *means
        )
    )


def _spread(
    rows: DataFrame, by: list[str], probs: Mapping[str, float], means: list[str]
) -> DataFrame:
    counted = (
        rows.withColumn("_b", value_cell(F.col("_v")))
        .groupBy(*by, "_b", "_v")
        .agg(
            F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(0)).alias("_c"),
            *[F.sum(f"_{t}_{m}").alias(f"_{t}_{m}") for m in means for t in "sk"],
        )
    )
    cells = counted.groupBy(*by, "_b").agg(
        F.sum("_c").alias("_c"),
        *[F.sum(f"_{t}_{m}").alias(f"_{t}_{m}") for m in means for t in "sk"],
    )
    # Both frames share one order, so one window operator serves them.
    by_cell = Window.partitionBy(*by).orderBy("_b")
    upto = by_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = cells.select(
        *by,
        "_b",
        "_c",
        (F.sum("_c").over(upto) - F.col("_c")).alias("_start"),
        F.sum("_c").over(whole).alias("_n"),
        *[
            F.try_divide(F.sum(f"_s_{m}").over(whole), F.sum(f"_k_{m}").over(whole)).alias(m)
            for m in means
        ],
    )

    def position(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    def ranks(p: float) -> tuple[Column, Column]:
        low = F.floor(position(p))
        return low, F.least(low + 1, F.col("_n") - 1)

    end = F.col("_start") + F.col("_c")
    holds = F.col("_n") == 0
    for p in probs.values():
        for rank in ranks(p):
            holds = holds | ((rank >= F.col("_start")) & (rank < end))
    hit = placed.filter(holds).drop("_c")
    # Always true, but it names every column: both readers of the counted table
    # then ask for the same ones, and its shuffle is done once and reused.
    whole_row = F.lit(False)
    for m in means:
        whole_row = whole_row | (F.col(f"_k_{m}") >= 0) | F.col(f"_s_{m}").isNull()
    inside = counted.filter(whole_row) if means else counted
    inside = inside.select(
        *[F.col(g).alias(f"_r{g}") for g in by], F.col("_b").alias("_rb"), "_v", "_c"
    )
    same = F.col("_b") == F.col("_rb")
    for g in by:
        same = same & F.col(g).eqNullSafe(F.col(f"_r{g}"))
    ranked = hit.join(inside, same, "inner")
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = ranked.withColumn("_last", F.col("_start") + F.sum("_c").over(within) - 1)
    first = F.col("_last") - F.col("_c") + 1

    picks = []
    for i, p in enumerate(probs.values()):
        for side, rank in zip("lh", ranks(p), strict=True):
            at = (rank >= first) & (rank <= F.col("_last"))
            picks.append(F.max(F.when(at, F.col("_v"))).alias(f"_{side}{i}"))
    final = ranked.groupBy(*by).agg(
        F.max("_n").alias("_n"), *picks, *[F.max(m).alias(m) for m in means]
    )
    out = []
    for i, (name, p) in enumerate(probs.items()):
        part = position(p) - F.floor(position(p))
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append((low + (high - low) * part).alias(name))
    return final.select(*by, *out, *means)


def five_number(
    df: DataFrame, value: Column | str, keys: Sequence[str] = (), spread: bool = True
) -> DataFrame:
    """0 / 25 / 50 / 75 / 100 % quantiles."""
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    return quantile_by(df, keys, value, probs, spread=spread)


def approx_quantile_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Sketch-based quantiles: one shuffle of bounded buffers, rank error 1/accuracy."""
    wanted = [float(p) for p in probs.values()]
    sketch = df.groupBy(*keys).agg(F.percentile_approx(value, wanted, accuracy).alias("_q"))
    return sketch.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def tset_by_group(
    df: DataFrame, temp: str = "temp", keys: Sequence[str] = ("id", "sex")
) -> DataFrame:
    """Preferred range per individual: interquartile range, mean, mean ± half of it."""
    q = quantile_by(
        df, keys, temp, {"_q25": 0.25, "_q75": 0.75}, means={"mean_tb": F.col(temp)}
    ).withColumn("iqr", F.col("_q75") - F.col("_q25"))
    return iqr_bounds(q.drop("_q25", "_q75"))


def iqr_bounds(df: DataFrame, mean: str = "mean_tb", iqr: str = "iqr") -> DataFrame:
    """Adds ``half_range``, ``upper`` and ``lower`` = mean ± iqr/2."""
    half = F.col(iqr) / 2
    return df.withColumns(
        {"half_range": half, "upper": F.col(mean) + half, "lower": F.col(mean) - half}
    )


def p95_hourly(
    df: DataFrame,
    value: str = "ms2",
    tb: str = "tb",
    keys: Sequence[str] = ("id", "hr", "date", "month", "sex", "season"),
    spread: bool = False,
) -> DataFrame:
    """95th percentile of movement and mean body temperature per hour.

    An hour of one individual holds as many readings as its logger takes, so the
    built-in aggregate serves (one shuffle). With keys that leave out the date or
    the individual, pass ``spread=True``.
    """
    return quantile_by(df, keys, value, {"p95": 0.95}, means={tb: F.col(tb)}, spread=spread)


def p95_binned(
    hourly: DataFrame,
    tb: str = "tb",
    keys: Sequence[str] = ("id", "season", "sex"),
    lo: float = -4.0,
    hi: float = 49.0,
    spread: bool = False,
) -> DataFrame:
    """Second pass: p95 of the hourly p95 and mean of means per whole degree.

    Hours of one individual at one degree: few by definition.
    """
    binned = hourly.withColumn("temp", F.rint(tb) + F.lit(0.0))
    out = quantile_by(
        binned, [*keys, "temp"], "p95", {"p95": 0.95}, means={tb: F.col(tb)}, spread=spread
    )
    return out.filter(F.col(tb).between(lo, hi))
