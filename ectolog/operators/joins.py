"""Joins: checked broadcasts, set-point bands, lookups and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.functions import setpoint_deviation
from ectolog.session import settle

#: Rows of a lookup that are broadcast, and bytes of them by the size of their types.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
#: Rows of one key that may go to one task, and the most tasks that a key is spread over.
ROWS_OF_A_KEY = 2_000_000
MAX_SALTS = 1024


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join that matches NULL keys with each other.

    The keys are packed into one struct: struct equality treats NULL fields as
    equal and stays hashable, so this is still a hash or merge join.
    """
    key = F.struct(*[F.col(c) for c in on]).alias("_key")
    rest = [c for c in right.columns if c not in on]
    packed = right.select(key, *rest)
    return left.withColumn("_key", key).join(packed, ["_key"], how).drop("_key")


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join a computed lookup table to a large table.

    The lookup is computed once (checkpointed) and measured. Up to
    ``max_rows`` rows and ``MAX_BROADCAST_BYTES`` it is broadcast and the large
    side does not move. Beyond that both sides are shuffled; keys with many rows
    are spread, see :func:`salted_join`.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"attach keeps the large side; {how!r} does not")
    dim = settle(dim)
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    strings = [F.coalesce(F.sum(F.length(f.name)), F.lit(0)) for f in dim.schema if f.dataType.typeName() == "string"]
    rows, *sizes = dim.agg(F.count(F.lit(1)), *strings).first()
    if rows <= limit and 16 * len(dim.columns) * rows + sum(sizes) <= MAX_BROADCAST_BYTES:
        return _equi_join(fact, F.broadcast(dim), on, how, null_safe)
    return salted_join(fact, dim, on, how, null_safe)


def _equi_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    join = null_safe_join if null_safe else lambda a, b, k, h: a.join(b, list(k), h)
    return join(left, right, on, how)


def salted_join(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str, null_safe: bool = False,
    rows_of_a_key: int | None = None,
) -> DataFrame:
    """Shuffle join that spreads the hot keys of the large side, and no others.

    Rows are counted by key first (each task counts its own). A key with more
    than ``rows_of_a_key`` rows gets as many salts as its rows need; its lookup
    rows are repeated for them, and all other lookup rows stay single. The salt
    comes from the row's own content, so it is the same on every retry.
    """
    most = ROWS_OF_A_KEY if rows_of_a_key is None else rows_of_a_key
    counted = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    needed = F.least(F.ceil(F.col("_n") / most), F.lit(MAX_SALTS)).cast("long")
    hot = settle(counted.select(*on, needed.alias("_salts")))
    if hot.isEmpty():
        return _equi_join(fact, dim, on, how, null_safe)
    # At most the rows of the table over ``most``: a bounded share of them.
    few = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_ROWS else hot
    content = [c for c, t in fact.dtypes if not t.startswith("map") and "map<" not in t]
    one = F.coalesce("_salts", F.lit(1).cast("long"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in content]), one)
    salted = null_safe_join(fact, few, on, "left").withColumn("_salt", salt).drop("_salts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("_salt")
    spread = null_safe_join(dim, few, on, "left").select(*dim.columns, salts)
    return _equi_join(salted, spread, [*on, "_salt"], how, null_safe).drop("_salt")


# ---- set-point bands -------------------------------------------------------

Band = tuple[float, float]

# Published preferred ranges (lower, upper) per sex.
PUBLISHED_BANDS: dict[str, Band] = {
    "ZWf": (26.97309, 33.80642),
    "ZZm": (25.33080, 32.03080),
}
# The truncated bounds and shared lower origin of the published
# deviations; use them only to reproduce those numbers.
TRUNCATED_BANDS: dict[str, Band] = {"ZWf": (26.97, 33.80), "ZZm": (25.33, 32.03)}
TRUNCATED_ORIGINS = {"ZWf": 26.97, "ZZm": 26.97309}


def _by_level(level: Column, values: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in reversed(list(values.items())):
        out = F.when(level == name, F.lit(float(value))).otherwise(out)
    return out


def band_deviation(
    df: DataFrame,
    x: str,
    bands: Mapping[str, Band] = PUBLISHED_BANDS,
    level: str = "sex",
    out: str = "db",
    lo_origin: Mapping[str, float] | None = None,
) -> DataFrame:
    """Deviation of each reading from the band of its own sex.

    The bands are a handful of driver-side values, so they become one CASE
    expression: no join and no per-sex branch. Rows of a sex without a band
    are dropped.
    """
    lo = _by_level(F.col(level), {k: v[0] for k, v in bands.items()})
    hi = _by_level(F.col(level), {k: v[1] for k, v in bands.items()})
    origin = None if lo_origin is None else _by_level(F.col(level), lo_origin)
    kept = df.filter(F.col(level).isin(*bands))
    return kept.withColumn(out, setpoint_deviation(F.col(x), lo, hi, origin))


def band_deviation_all(
    df: DataFrame,
    x: str,
    bands: Mapping[str, Band] = PUBLISHED_BANDS,
    level: str = "analysis",
    out: str = "de",
    lo_origin: Mapping[str, float] | None = None,
) -> DataFrame:
    """Deviation of each reading from every band: one row per reading and sex."""
    origins = lo_origin or {}
    rows = F.array(
        *[
            F.struct(
                F.lit(f"de_{name}").alias(level),
                setpoint_deviation(F.col(x), lo, hi, origins.get(name)).alias(out),
            )
            for name, (lo, hi) in bands.items()
        ]
    )
    return df.withColumn("_band", F.explode(rows)).select(
        *[F.col(c) for c in df.columns], F.col(f"_band.{level}"), F.col(f"_band.{out}")
    )


def bands_from_table(
    df: DataFrame, table: DataFrame, x: str, level: str = "sex", out: str = "db"
) -> DataFrame:
    """Like :func:`band_deviation` with the bands in a computed table.

    ``table`` has the columns ``level``, ``lower`` and ``upper``.
    """
    dim = table.select(level, F.col("lower").alias("_lo"), F.col("upper").alias("_hi"))
    joined = attach(df, dim, [level])
    return joined.withColumn(
        out, setpoint_deviation(F.col(x), F.col("_lo"), F.col("_hi"))
    ).drop("_lo", "_hi")


def band_match(df: DataFrame, bands: DataFrame, x: str, width: float) -> DataFrame:
    """Readings that lie inside a band: a range join on ``lower``/``upper``.

    Both sides are cut into cells of ``width``; the cell makes it an
    equi-join, the bounds then decide. A band appears once in every cell it
    covers, so each reading meets each of its bands once.
    """
    cell = F.floor(F.col(x) / width)
    first, last = F.floor(F.col("lower") / width), F.floor(F.col("upper") / width)
    cut = bands.withColumn("_cell", F.explode(F.sequence(first, last)))
    inside = F.col(x).between(F.col("lower"), F.col("upper"))
    return attach(df.withColumn("_cell", cell), cut, ["_cell"]).filter(inside).drop("_cell")


# ---- lookups ---------------------------------------------------------------


def join_dim_de(db: DataFrame, de: DataFrame, on: Sequence[str] = ("sex", "season")) -> DataFrame:
    """Look up the seasonal habitat deviation for each individual."""
    return attach(db, de, on)


def keep_min_days(
    df: DataFrame, min_days: int = 7, by: str = "id", date: str = "date", keep: bool = True
) -> DataFrame:
    """Keep (or, with ``keep=False``, list) individuals tracked long enough."""
    from ectolog.operators.aggregate import tracking_days

    long_enough = (
        tracking_days(df.filter(F.col(by).isNotNull()), by, date)
        .filter(F.col("days") >= min_days)
        .select(by)
    )
    return attach(df, long_enough, [by], "left_semi" if keep else "left_anti")


def join_obs_pred(
    observed: DataFrame, predicted: DataFrame, on: Sequence[str] = ("date", "hr")
) -> DataFrame:
    """Inner join on date and hour; other shared columns get a suffix."""
    shared = [c for c in observed.columns if c in predicted.columns and c not in on]
    left = observed.withColumnsRenamed({c: f"{c}_observed" for c in shared})
    right = predicted.withColumnsRenamed({c: f"{c}_predicted" for c in shared})
    return left.join(right, list(on), "inner")


def bind_columns(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Put the columns of two tables side by side, matched by key."""
    return null_safe_join(first, second, on, "inner")


def grid_cross(
    levels: DataFrame,
    ranges: DataFrame,
    on: str,
    factors: Mapping[str, Sequence[str]],
    steps: int = 100,
    x: str = "temp",
) -> DataFrame:
    """Prediction grid: each level × factor values × an even sequence of x.

    ``levels`` holds the distinct ids, ``ranges`` one (lo, hi) row per value
    of ``on`` (itself one of the factors). Factor values are driver-side
    lists and the sequence is generated per row, so the product is a chain of
    explodes and never a cross join.
    """
    out = levels
    for name, values in factors.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    # One row per listed value: as many rows as the caller listed.
    spans = F.broadcast(ranges.filter(F.col(on).isin(*factors[on])))
    out = out.join(spans, [on])
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_i") / F.lit(float(steps - 1))
    return out.select("*", step).withColumn(x, at).drop("_i", "lo", "hi")
