"""Grouped summaries. All use partial aggregation; group keys carry labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.functions import active_flag, strict


#: Rows that one task groups.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, keys: Sequence[str], rows_a_task: int | None = None) -> DataFrame:
    """Large tables dealt by ``keys`` over as many tasks as their rows need.

    For groupings with nearly as many groups as rows: a task's table of groups would
    grow with the input where the number of tasks is set once for a session. Tables
    that this number suffices for stay as they are.
    """
    needed = -(-df.count() // (rows_a_task or ROWS_A_TASK))
    if needed <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(needed, *keys)


def mean_by(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], na: str = "skip"
) -> DataFrame:
    """Grouped means (output name -> column).

    ``na="strict"`` gives NULL for a group with any NULL cell, ``"skip"``
    averages the others.
    """
    aggs = []
    for name, col in cols.items():
        mean = F.avg(col)
        aggs.append((strict(mean, F.col(col)) if na == "strict" else mean).alias(name))
    return df.groupBy(*keys).agg(*aggs)


def std_error(x: Column | str) -> Column:
    """Standard error of a mean; NULL for a single row."""
    x = F.col(x) if isinstance(x, str) else x
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def mean_se(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), std_error(x).alias("se"))


def daily_minmaxmean(
    df: DataFrame, x: str, keys: Sequence[str] = ("date", "season")
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max(x).alias("max"), F.min(x).alias("min"), F.avg(x).alias("mean")
    )


def data_range(df: DataFrame, x: str) -> DataFrame:
    """One row: smallest, largest, spread and mean."""
    return df.agg(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"),
        F.avg(x).alias("mean"),
    )


def sample_sizes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def sample_sizes_and_total(df: DataFrame, key: str, total: str = "All") -> DataFrame:
    """Rows per value of ``key`` and of the whole table, from one scan."""
    counted = df.rollup(key).agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("_all") == 1, total).otherwise(F.col(key))
    return counted.select(name.alias(key), "n")


def tracking_days(df: DataFrame, by: str = "id", date: str = "date") -> DataFrame:
    """Days with data per individual.

    The days are made distinct first, hashed on (individual, day).
    """
    days = df.select(by, date).filter(F.col(date).isNotNull()).distinct()
    return days.groupBy(by).agg(F.count(F.lit(1)).alias("days"))


def day_bitmaps(df: DataFrame, by: str = "id", date: str = "date") -> DataFrame:
    """``by``, ``bucket``, ``days``: the days with data as bits, 32,768 days a bitmap.

    Kept as a table, they stand for the readings: bitmaps of files or micro-batches
    are merged by ``merge_days``, whatever they have in common.
    """
    # Day numbers begin with 1, as positions in a bitmap do.
    day = (F.datediff(date, F.lit("0001-01-01").cast("date")) + 1).cast("long")
    rows = df.where(F.col(date).isNotNull()).select(by, day.alias("day"))
    bucket = F.bitmap_bucket_number("day").alias("bucket")
    return rows.groupBy(by, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias("days"))


def merge_days(bitmaps: DataFrame, by: str = "id") -> DataFrame:
    """Bitmaps of several sources as one for each individual and bucket."""
    return bitmaps.groupBy(by, "bucket").agg(F.bitmap_or_agg("days").alias("days"))


def days_of(bitmaps: DataFrame, by: str = "id") -> DataFrame:
    """Days with data per individual, from merged bitmaps."""
    return bitmaps.groupBy(by).agg(F.sum(F.bitmap_count("days")).alias("days"))


def carry_unique(df: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """One row per group with attributes that must not vary inside it.

    A group whose attribute has two values raises when the row is computed; NULL
    beside a value counts as two.
    """
    known = [F.count(c).alias(f"_n_{c}") for c in carried]
    lows = [F.min(c).alias(f"_lo_{c}") for c in carried]
    highs = [F.max(c).alias(f"_hi_{c}") for c in carried]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *known, *lows, *highs)
    checked = []
    for c in carried:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        differs = F.raise_error(F.lit(f"{c} differs inside a group"))
        whole = F.col(f"_n_{c}").isin(F.lit(0), F.col("_n"))
        checked.append(F.when(lo.eqNullSafe(hi) & whole, lo).otherwise(differs).alias(c))
    return out.select(*keys, *checked)


def replicate_unique(
    df: DataFrame,
    keys: Sequence[str] = ("id", "date"),
    carried: Sequence[str] = ("season", "sex"),
    tb: str = "tb",
    hr: str = "hr",
) -> DataFrame:
    """Daily mean repeated for every hour of the day that has data.

    The hours seen are kept as the bits of one integer (24 at most), so the
    mean and the hours come out of a single aggregation and no join.
    """
    bit = F.expr(f"shiftleft(1, cast({hr} as int))")
    daily = df.groupBy(*keys, *carried).agg(
        F.avg(tb).alias(tb), F.bit_or(bit).alias("_hours")
    )
    hours = F.filter(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.col("_hours").bitwiseAND(F.call_function("shiftleft", F.lit(1), h)) != 0,
    )
    return daily.select(*keys, F.explode(hours).alias(hr), tb, *carried)


def individual_db(
    df: DataFrame,
    keys: Sequence[str] = ("id", "date", "hr"),
    carried: Sequence[str] = ("season", "sex"),
    db: str = "db",
    tb: str = "tb",
) -> DataFrame:
    return df.groupBy(*keys, *carried).agg(F.avg(db).alias("individual_db"), F.avg(tb).alias(tb))


def habitat_quality(
    df: DataFrame,
    keys: Sequence[str] = ("date", "type", "model_id", "hr"),
    carried: Sequence[str] = ("season", "analysis"),
) -> DataFrame:
    """Mean temperature, deviation and in-range share per model, hour and band."""
    return df.groupBy(*keys, *carried).agg(
        F.avg("te").alias("te"), F.avg("de").alias("de"), F.avg("ex").alias("ex")
    )


def grand_mean_de(df: DataFrame, keys: Sequence[str] = ("analysis", "season")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("de").alias("de_season"))


def season_db(df: DataFrame, keys: Sequence[str] = ("id", "season", "sex")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("db").alias("db_mean"))


def hourly_profile(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias(x))


def active_minutes(
    df: DataFrame,
    acc: str = "acc",
    temp: str = "tsurf",
    keys: Sequence[str] = ("date", "hr", "id"),
    carried: Sequence[str] = ("sex", "season"),
) -> DataFrame:
    """Active readings and mean temperature per individual and hour."""
    return df.groupBy(*keys, *carried).agg(
        F.sum(active_flag(F.col(acc))).alias("freq"), F.avg(temp).alias("temp")
    )


def activity_profile(
    minutes: DataFrame, keys: Sequence[str] = ("season", "sex", "hr")
) -> DataFrame:
    """Mean of the hourly sums with its standard error."""
    return minutes.groupBy(*keys).agg(
        F.avg("temp").alias("tsurf"),
        F.avg("freq").alias("movement_hr"),
        std_error("freq").alias("se"),
    )


def activity_by_id(minutes: DataFrame, keys: Sequence[str] = ("season", "sex", "id")) -> DataFrame:
    return activity_profile(minutes, keys)
