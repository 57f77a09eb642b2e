"""Projections, filters and row hygiene."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename_cols(df: DataFrame, names: Mapping[str, str] | Mapping[int, str]) -> DataFrame:
    """Rename by old name or by 0-based position."""
    by_name = {df.columns[k] if isinstance(k, int) else k: v for k, v in names.items()}
    return df.withColumnsRenamed(by_name)


def derive_cols(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(cols))


def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def filter_hours(df: DataFrame, first: int = 5, last: int = 21, hr: str = "hr") -> DataFrame:
    """Daylight band, both hours included."""
    return df.filter(F.col(hr).between(first, last))


def filter_dates(
    df: DataFrame,
    start: str | None = None,
    until: str | None = None,
    before: str | None = None,
    date: str = "date",
) -> DataFrame:
    """Keep ``start <= date <= until`` and ``date < before``.

    Limits may be written with dashes or slashes; they become date literals
    on the driver so the filter can reach the scan.
    """

    def limit(text: str) -> Column:
        return F.lit(text.replace("/", "-")).cast("date")

    if start is not None:
        df = df.filter(F.col(date) >= limit(start))
    if until is not None:
        df = df.filter(F.col(date) <= limit(until))
    if before is not None:
        df = df.filter(F.col(date) < limit(before))
    return df


def filter_category(
    df: DataFrame, col: str, keep: Sequence[str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Keep some labels and/or drop others; a NULL label passes neither test."""
    if keep is not None:
        df = df.filter(F.col(col).isin(*keep))
    if drop:
        df = df.filter(~F.col(col).isin(*drop))
    return df


def filter_band(df: DataFrame, x: str = "tb", lo: float = -4.0, hi: float = 49.0) -> DataFrame:
    return df.filter(F.col(x).between(lo, hi))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of the columns."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def union_rows(*tables: DataFrame, fill: bool = False) -> DataFrame:
    """Stack tables by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=fill)
    return out


def sort_by(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.orderBy(*cols)
