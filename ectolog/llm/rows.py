"""Rows in and out of Arrow batches, and the columns the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.session import rows_at_a_time, scratch_path, shuffles_freed

#: Spaces of the word patterns; ``bytes.split()`` without arguments splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns never clash."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def one_space(text: Column) -> Column:
    """Each run of the six ASCII spaces as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


#: Rows of a lookup that may be broadcast (16 to 40 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """A computed lookup, with a broadcast hint if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Texts that go to a Python task at a time where a table is stored.
TEXTS_AT_A_TIME = 2_000


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: compressed, unlike a checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with shuffles_freed(spark), rows_at_a_time(spark, TEXTS_AT_A_TIME):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` each, one row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def releasing(run: Callable) -> Callable:
    """The same task, after which free buffers go back: its process stays and serves others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # By now the task's own tables and batches are gone.
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole
