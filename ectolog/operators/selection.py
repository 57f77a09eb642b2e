"""Exact quantiles by selection over digits: no group and no range of values is ranked in one task.

A double becomes a 64-bit whole number of the same order. Four passes look at 16
bits each: values are counted by the digit (partial sums in every task), the at
most 65,536 counts of a range tell which digit holds a wanted rank, and only that
range is counted by the next digit. After the last pass the digit is one value. A
group of any size, or a million different values that lie close together, costs
four such counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that are left below the digits of each pass.
SHIFTS = (48, 32, 16, 0)
_MASK = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A long in the order of the doubles; both zeros are one, NaN and NULL have none."""
    plain = F.when(~F.isnan(value), value + F.lit(0.0))
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(plain.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_MASK))))


def quantiles_by_digits(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    weight: Column | None = None,
) -> DataFrame:
    """Interpolated quantiles (type 7) of each group, exact at any size of a group.

    ``keys``, then a column for each of ``probs``. Groups without values have NULL;
    NULL keys are a group; ``weight`` counts a row several times.
    """
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    rows = df.select(
        group.alias("g"),
        F.when(~F.isnan(value.cast("double")), value.cast("double") + F.lit(0.0)).alias("v"),
        (F.lit(1) if weight is None else weight).cast("long").alias("w"),
    )
    counted = rows.groupBy("g", "v").agg(F.sum("w").alias("c"))
    counted = counted.withColumn("key", ordered_bits(F.col("v"))).where("c > 0 OR key IS NULL")

    def place(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    held = F.sum(F.when(F.col("key").isNotNull(), F.col("c")).otherwise(0))
    groups = counted.groupBy("g").agg(held.alias("n"))
    targets = []
    for name, p in probs.items():
        low = F.floor(place(p))
        for side, rank in (("low", low), ("high", F.least(low + 1, F.col("n") - 1))):
            targets.append(F.struct(F.lit(f"{name}.{side}").alias("what"), rank.alias("rank")))
    wanted = groups.where("n > 0").select("g", F.inline(F.array(*targets)), F.lit(0).cast("long").alias("digit"))

    for number, shift in enumerate(SHIFTS):
        above = F.shiftright("key", SHIFTS[number - 1]) if number else F.lit(0).cast("long")
        cells = counted.where("key IS NOT NULL").select(
            "g", above.alias("digit"), F.shiftright("key", shift).alias("next"), "c", "v"
        )
        if number:
            cells = cells.join(wanted.select("g", "digit").distinct(), ["g", "digit"], "left_semi")
        cells = cells.groupBy("g", "digit", "next").agg(F.sum("c").alias("c"), F.max("v").alias("v"))
        upto = Window.partitionBy("g", "digit").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("end", F.sum("c").over(upto))
        start = F.col("end") - F.col("c")
        found = wanted.drop("v").join(cells, ["g", "digit"]).where((F.col("rank") >= start) & (F.col("rank") < F.col("end")))
        wanted = found.select("g", "what", (F.col("rank") - start).alias("rank"), F.col("next").alias("digit"), "v")

    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("v")))
    ends = [pick(f"{name}.{side}").alias(f"{name}.{side}") for name in probs for side in ("low", "high")]
    values = wanted.groupBy("g").agg(*ends) if probs else wanted.select("g").distinct()
    joined = groups.join(values, "g", "left")
    out = []
    for name, p in probs.items():
        low, high = F.col(f"`{name}.low`"), F.col(f"`{name}.high`")
        part = place(p) - F.floor(place(p))
        out.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return joined.select(*[F.col("g").getField(k).alias(k) for k in keys], *out)


def five_number_by_digits(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """0 / 25 / 50 / 75 / 100 % quantiles."""
    return quantiles_by_digits(df, keys, value, {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})


def tset_by_digits(df: DataFrame, temp: str = "temp", keys: Sequence[str] = ("id", "sex")) -> DataFrame:
    """Interquartile range by group."""
    found = quantiles_by_digits(df, keys, temp, {"q25": 0.25, "q75": 0.75})
    return found.select(*keys, (F.col("q75") - F.col("q25")).alias("iqr"))
