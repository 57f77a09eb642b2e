"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.functions import code_list, round_half_even


def write_snapshot(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Persist a stage table, partitioned on disk.

    Each task writes its own rows; nothing is shuffled to one writer per
    partition value.
    """
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: Files a task may have open; rows of further partitions are sorted, and spilled where memory is short.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
MOST_OPEN = 4


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of; all others stay as they are.

    Rows are dealt out by partition first, in shares of the advisory size, so that a
    small partition is one file and a large one isn't one task. A task has few partitions
    then, and keeps their files open side by side in place of sorting its rows by them.
    Files appear when the whole write has succeeded; of a write that is killed nothing is seen.
    """
    spark = df.sparkSession
    before = spark.conf.get(OPEN_FILES, None)
    spark.conf.set(OPEN_FILES, str(MOST_OPEN))
    try:
        (
            df.hint("rebalance", *[F.col(c) for c in partition_by])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_by)
            .parquet(path)
        )
    finally:
        spark.conf.unset(OPEN_FILES) if before is None else spark.conf.set(OPEN_FILES, before)


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, by: Sequence[str], sort_by: Sequence[str] = ()
) -> DataFrame:
    """A table at ``path`` whose rows are bucketed and sorted on disk; returned as read back.

    Joins and aggregates of such tables on ``by`` need no exchange. The rows are dealt
    out once, here, so that each bucket is one file.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by)
    writer.sortBy(*(sort_by or by)).saveAsTable(table)
    return spark.table(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def history_rows(
    survived: Column, groups: Sequence[Column], covariates: Sequence[Column], digits: int = 3
) -> Column:
    """Encounter-history text: history, group dummies, rounded covariates, ``;``.

    Covariates are written without trailing zeros. A row whose survival is not
    known raises: it has no history.
    """
    unknown = F.raise_error(F.lit("survival is not known"))
    history = F.when(survived, "10").when(~survived, "11").otherwise(unknown)
    # Zeros go only behind a point: a whole number keeps its own.
    tail = r"(\.[0-9]*?)0+$"
    shown = [
        F.regexp_replace(
            F.regexp_replace(F.format_string(f"%.{digits}f", round_half_even(c, digits)), tail, "$1"), r"\.$", ""
        )
        for c in covariates
    ]
    return code_list(history, *groups, *shown)


def write_history(df: DataFrame, row: Column, path: str) -> None:
    df.select(row.alias("value")).write.mode("overwrite").text(path)


def save_model(fit: dict[str, DataFrame], path: str) -> None:
    """A fitted model is a set of plain tables (coefficients, covariance, ...)."""
    for name, table in fit.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}
