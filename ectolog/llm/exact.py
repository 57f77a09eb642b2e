"""Exact deduplication by a stateful stream over digests.

Each document becomes a record: digest of its normalised text, identifier, file
it stands in (content locator). A structured stream groups the records by
digest. Its state is kept in RocksDB on disk, has no watermark and so never
expires; it retains for each digest the smallest identifier, its locator and the
number of rows. Records are combined in each task before they are dealt out, so
a text that fills a third of the table sends one row a task. A digest seen more
than once is a hit: the whole texts of its rows are then compared with the text
of the row that stays, and rows that only share the digest are grouped by their
text instead.

Defined cases: null text counts as empty; empty texts are equal to each other;
of equal texts the row with the smallest ``doc_id`` stays; a row without
``doc_id`` never stays while another row has one; rows that repeat a ``doc_id``
and its text are one document and share the decision, though each is counted; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.llm.rows import bounded, id_and_text, one_space
from ectolog.session import scratch_path, settle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "doc_id long, digest string, place string"
#: Digests of hits that are broadcast; beyond it the texts are dealt out by digest.
BROADCAST_DIGESTS = 300_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def records(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id``, ``digest``, ``place`` of each row."""
    return id_and_text(docs).select(
        "doc_id", digest(one_space(F.col("text"))).alias("digest"), F.input_file_name().alias("place")
    )


def groups(stream: DataFrame) -> DataFrame:
    """The state: ``keep_id``, ``place``, ``n`` of each ``digest`` of a stream of records."""
    return stream.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.min_by("place", "doc_id").alias("place"),
        F.count("*").alias("n"),
    )


#: State in RocksDB; checkpoints carry what changed, and no file is allocated ahead of its content.
#: All partitions of an executor share one bound of memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


@contextmanager
def _on_disk(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_stream(spark: SparkSession, stream: DataFrame, to: str, checkpoint: str) -> DataFrame:
    """Run the state over all records there are; ``digest``, ``keep_id``, ``n`` afterwards.

    A batch writes the groups it has changed under its own number, so that one
    that is run again replaces what it wrote. A later call with the same folders
    goes on where this one ended.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{to}/batch={number}")

    with _on_disk(spark):
        run = (
            groups(stream)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    schema = "digest string, keep_id long, place string, n long, batch int"
    # Groups only grow: the latest state has the smallest id and the largest number.
    return (
        spark.read.schema(schema)
        .parquet(to)
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.max("n").alias("n"))
    )


def _texts_that_differ(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """``doc_id``, ``digest``, ``text`` of rows whose text isn't that of the row that stays."""
    rows = id_and_text(docs).select("doc_id", one_space(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    few = hits.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(hits) if few else hits, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = rows.where(stays).groupBy("digest").agg(F.min("text").alias("kept_text"))
    return (
        rows.join(kept, "digest")
        .where(F.col("text") != F.col("kept_text"))
        .select("doc_id", "digest", "text")
    )


def dedup(
    spark: SparkSession,
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` of each row of ``docs``."""
    feed = scratch_path(spark, "dedup-feed")
    records(docs, digest).write.parquet(feed)
    stream = (
        spark.readStream.schema(RECORD)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(feed)
    )
    to, checkpoint = scratch_path(spark, "dedup-groups"), scratch_path(spark, "dedup-state")
    state = settle(run_stream(spark, stream, to, checkpoint))
    hits = state.where("n > 1").select("digest", "keep_id")
    differ = settle(_texts_that_differ(docs, hits, digest))
    rows = spark.read.schema(RECORD).parquet(feed).select("doc_id", "digest")
    if differ.isEmpty():
        found = rows.join(state, "digest").select("doc_id", "digest", "keep_id", "n")
    else:
        found = _apart(rows, state, differ)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def _apart(rows: DataFrame, state: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows that share a digest but not the text, grouped by their whole text."""
    less = differ.groupBy("digest").agg(F.count("*").alias("less"))
    state = state.join(less, "digest", "left").withColumn(
        "n", F.col("n") - F.coalesce("less", F.lit(0))
    )
    own = differ.groupBy("digest", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    moved = differ.join(own, ["digest", "text"]).select("doc_id", "digest", "keep_id", "n")
    left = rows.join(
        differ.select("doc_id", "digest").distinct().withColumnsRenamed({"doc_id": "d", "digest": "g"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")),
        "left_anti",
    )
    stay = left.join(state, "digest").select("doc_id", "digest", "keep_id", "n")
    return stay.unionByName(moved)


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = dedup(spark, docs).where("NOT kept").select(F.col("doc_id").alias("__doc_id"), "digest")
    gone = settle(gone.withColumnRenamed("digest", "__digest").distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    text = one_space(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bounded(gone), same & (sha256(text) == F.col("__digest")), "left_anti")
