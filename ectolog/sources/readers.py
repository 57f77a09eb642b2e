"""Sources."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def clean_name(name: str) -> str:
    """Lower-case name of letters, digits and underscores."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Header CSV under a declared schema; a byte-order mark is ignored."""
    return spark.read.csv(path, header=True, schema=schema, **options)


class Checked(NamedTuple):
    """Rows that fit the schema, lines that don't, and their counts once either has been read."""

    rows: DataFrame
    refused: DataFrame
    counts: Observation


#: Column that holds the text of a line that doesn't fit.
REFUSED = "_refused"


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: StructType | str, **options) -> Checked:
    """Header CSV under a declared schema, with lines that don't fit set apart.

    A line is refused if a cell can't be read as its type or the number of cells
    differs. ``refused`` has ``file`` and ``line`` (its text); ``counts`` observes
    ``lines`` and ``refused`` in the first action on ``rows``. Nothing is dropped:
    every line is in one of the two.
    """
    given = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wider = StructType([*given.fields, StructField(REFUSED, StringType())])
    # Cells are read even if their column isn't asked for: a line is bad for every reader or none.
    read = (
        spark.read.options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REFUSED)
        .option("columnPruning", False)
        .csv(path, header=True, schema=wider)
    )
    # Always true, but names every column: Spark refuses to read the refused text alone.
    whole_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in given.fields]) >= F.lit(-(1 << 63))
    named = read.select("*", F.col("_metadata.file_path").alias("_file")).where(whole_row)
    counts = Observation()
    seen = named.observe(counts, F.count(F.lit(1)).alias("lines"), F.count(REFUSED).alias("refused"))
    return Checked(
        seen.where(F.col(REFUSED).isNull()).select(*[F.col(f"`{f.name}`") for f in given.fields]),
        named.where(F.col(REFUSED).isNotNull()).select(F.col("_file").alias("file"), F.col(REFUSED).alias("line")),
        counts,
    )


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV whose numbers stay text exactly as written."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema)


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stage table saved earlier."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def sanitise(df: DataFrame) -> DataFrame:
    """Give every column a plain name, once, at the source."""
    return df.withColumnsRenamed({c: clean_name(c) for c in df.columns})
