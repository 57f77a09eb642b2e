"""Hourly movement summary over the live sensor feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.operators.quantiles import quantile_by

HOURLY_SCHEMA = "start timestamp, end timestamp, id long, p95 double, tb double"


def hourly_counts(
    feed: DataFrame,
    value: str = "ms2",
    tb: str = "tb",
    id: str = "id",
    ts: str = "ts",
    delay: str = "2 hours",
    width: str = "1 hour",
) -> DataFrame:
    """Streaming value counts per (hour, individual, value).

    The state is keyed by the value as well, so a busy individual is spread
    over the state partitions and no state row grows with the feed.
    """
    clean = F.when(~F.isnan(value), F.col(value))
    return (
        feed.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, width), F.col(id).alias("id"), clean.alias("v"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum(tb).alias("s"), F.count(tb).alias("k"))
    )


def close_hours(counts: DataFrame) -> DataFrame:
    """Finished hours: exact 95th percentile of movement and mean temperature."""
    keys = ["start", "end", "id"]
    rows = counts.select("window.start", "window.end", "id", "v", "c", "s", "k")
    tb = {"tb": (F.col("s"), F.col("k"))}
    # An hour of one individual: the values are few, and one shuffle finishes them.
    return quantile_by(
        rows, keys, "v", {"p95": 0.95}, means=tb, weight=F.col("c"), spread=False
    )


def stream_hourly(feed: DataFrame, out_path: str, checkpoint: str, **options) -> None:
    """Run the feed to its present end and append each closed hour once.

    An hour leaves the state as a whole when the watermark passes it, so one
    micro-batch holds all its counts. Every micro-batch writes its own folder
    and overwrites it when it is retried.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            close_hours(kept).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        finally:
            kept.unpersist()

    stream = (
        hourly_counts(feed, **options)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    stream.awaitTermination()
