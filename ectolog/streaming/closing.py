"""Hours that close themselves: by the watermark, or once nothing has come for a while.

``stream_hourly`` closes an hour when later readings push the watermark past it,
so the last hours of a feed that stops never leave its state. Here each hour of an
individual is held (values with their counts, sum and count of temperature) until
the watermark has passed its end, or no reading of it has come for ``idle``. A closed
hour stays known for ``remember``; readings that come for it meanwhile, or for an hour
the watermark passed before, are late: they go to an output of their own, unchanged.

An hour of an individual is a few readings, and a state with a timer costs far more
than these. So the individuals of an hour are dealt by hash over ``SHARES`` states,
whose hours lie side by side in arrays and are merged and closed at once; each hour
in them still closes by itself.

The state holds the open hours and the recently closed ones, whatever the length
of the feed. ``drain`` reads what is still open out of a stopped query's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``ts``, ``value``, ``tb`` of a late reading; ``p95`` and ``tb`` of a closed hour.
OUT = "late boolean, start timestamp, id long, p95 double, tb double, n long, ts timestamp, value double"
#: Hours of a share, by ``ids`` in order: ``vals`` and ``counts`` of the i-th lie from ``at[i]`` to ``at[i + 1]``.
STATE = (
    "ids array<long>, closed array<boolean>, last array<long>, s array<double>, k array<long>, n array<long>, "
    "at array<long>, vals array<double>, counts array<long>"
)
TYPES = dict(
    ids=np.int64, closed=bool, last=np.int64, s=float, k=np.int64, n=np.int64, at=np.int64, vals=float, counts=np.int64
)
#: States an hour's individuals are dealt over; rows without an individual have one of their own.
SHARES = 16
NOBODY = -1
WIDTH_MS = 3_600_000
#: A timer can't be armed for no time at all.
LEAST_MS = 1
P95 = 0.95


class Hours:
    """The hours of one share, as arrays by individual."""

    def __init__(self, held: tuple | None = None):
        held = held or ([], [], [], [], [], [], [0], [], [])
        for (name, kind), values in zip(TYPES.items(), held, strict=True):
            setattr(self, name, np.asarray(values, kind))

    def held(self) -> tuple:
        return tuple(getattr(self, name).tolist() for name in TYPES)

    def take(self, kept: np.ndarray) -> None:
        """Keep only some of the hours."""
        in_runs = np.repeat(kept, np.diff(self.at))
        self.at = np.r_[0, np.cumsum(np.diff(self.at)[kept])]
        self.vals, self.counts = self.vals[in_runs], self.counts[in_runs]
        for name in ("ids", "closed", "last", "s", "k", "n"):
            setattr(self, name, getattr(self, name)[kept])

    def empty(self, gone: np.ndarray, now: int) -> None:
        """Close some of the hours: only that they were there stays."""
        kept = np.repeat(~gone, np.diff(self.at))
        self.at = np.r_[0, np.cumsum(np.where(gone, 0, np.diff(self.at)))]
        self.vals, self.counts = self.vals[kept], self.counts[kept]
        self.closed, self.last = self.closed | gone, np.where(gone, now, self.last)
        self.s, self.k = np.where(gone, 0.0, self.s), np.where(gone, 0, self.k)

    def known(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``ids``, and which of them are held."""
        place = np.searchsorted(self.ids, ids)
        there = place < len(self.ids)
        there[there] = self.ids[place[there]] == ids[there]
        return place, there

    def add(self, ids: np.ndarray, values: np.ndarray, tb: np.ndarray, now: int) -> None:
        """Merge readings of open hours, and of hours not seen before."""
        new = np.unique(ids)
        new = new[~self.known(new)[1]]
        order = np.argsort(np.r_[self.ids, new], kind="stable")
        owner = np.r_[np.repeat(self.ids, np.diff(self.at)), ids]
        for name, first in (("ids", new), ("closed", False), ("last", now), ("s", 0.0), ("k", 0), ("n", 0)):
            old = getattr(self, name)
            setattr(self, name, np.r_[old, np.broadcast_to(np.asarray(first, old.dtype), new.shape)][order])
        at, size = np.searchsorted(self.ids, ids), len(self.ids)
        seen = ~np.isnan(tb)
        self.last[at] = now
        self.s = self.s + np.bincount(at[seen], tb[seen], size)
        self.k = self.k + np.bincount(at[seen], minlength=size)
        self.n = self.n + np.bincount(at, minlength=size)
        # Equal values of an hour become one with their count.
        vals, counts = np.r_[self.vals, values], np.r_[self.counts, np.ones(len(values), np.int64)]
        real = ~np.isnan(vals)
        owner, vals, counts = owner[real], vals[real], counts[real]
        order = np.lexsort((vals, owner))
        owner, vals, counts = owner[order], vals[order], counts[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (vals[1:] != vals[:-1])][: len(vals)])
        self.vals = vals[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self.at = np.r_[0, np.cumsum(np.bincount(np.searchsorted(self.ids, owner[first]), minlength=size))]

    def rows(self, start: pd.Timestamp, share: int, which: np.ndarray) -> pd.DataFrame:
        """Hours as they close: interpolated quantile of the counted values, mean temperature, readings."""
        upto = np.r_[0, np.cumsum(self.counts)]
        before, total = upto[self.at[:-1]][which], np.diff(upto[self.at])[which]
        p95 = np.full(len(total), np.nan)
        some = total > 0
        place = (total[some] - 1) * P95
        low = np.floor(place).astype(np.int64)
        high = np.minimum(low + 1, total[some] - 1)
        a, b = (self.vals[np.searchsorted(upto[1:], before[some] + r, side="right")] for r in (low, high))
        p95[some] = a + (b - a) * (place - low)
        k = self.k[which]
        tb = np.where(k > 0, self.s[which] / np.maximum(k, 1), np.nan)
        return pd.DataFrame(
            {"late": False, "start": start, "id": _ids(self.ids[which], share), "p95": p95, "tb": tb, "n": self.n[which]}
        )


def _ids(ids: np.ndarray, share: int) -> pd.Series:
    return pd.Series(ids, dtype="Int64").mask(np.full(len(ids), share == NOBODY))


def closing_hours(
    feed: DataFrame,
    value: str = "ms2",
    tb: str = "tb",
    id: str = "id",
    ts: str = "ts",
    delay: str = "2 hours",
    idle_ms: int = 2 * WIDTH_MS,
    remember_ms: int = 24 * WIDTH_MS,
    poll_ms: int = 60_000,
    shares: int = SHARES,
) -> DataFrame:
    """The stream of closed hours and late readings (``OUT``).

    ``idle_ms`` should be no less than ``delay`` on a live feed; ``poll_ms`` is how
    often open hours look at the watermark. ``shares`` may not change between runs
    of one checkpoint.
    """
    timer = max(LEAST_MS, min(idle_ms, poll_ms))
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, share = key
        ended = int(start.timestamp() * 1000) + WIDTH_MS
        # Both are frozen for a micro-batch, so a retry decides alike.
        now, passed = state.getCurrentProcessingTimeMs(), state.getCurrentWatermarkMs() >= ended
        hours = Hours(state.get if state.exists else None)
        fed = np.zeros(0, np.int64)
        for part in () if state.hasTimedOut else parts:
            ids = part["id"].to_numpy(np.int64)
            place, there = hours.known(ids)
            # An hour that is open still counts its readings, also behind the watermark.
            late = np.full(len(ids), passed)
            late[there] = hours.closed[place[there]]
            if late.any():
                hours.last[place[there & late]] = now
                out = part[late].assign(late=True, start=start, id=_ids(ids[late], share).to_numpy())
                yield out.reindex(columns=names)
            live = part[~late]
            hours.add(ids[~late], live["value"].to_numpy(float), live["tb"].to_numpy(float), now)
            fed = np.union1d(fed, ids[~late])
        due = ~hours.closed & ~np.isin(hours.ids, fed) & (passed | (now - hours.last >= idle_ms))
        if due.any():
            yield hours.rows(start, share, due).reindex(columns=names)
            hours.empty(due, now)
        hours.take(~hours.closed | (now - hours.last < remember_ms) | due)
        if not len(hours.ids):
            if state.exists:
                state.remove()
            return
        state.update(hours.held())
        rest = remember_ms - (now - int(hours.last.min()))
        state.setTimeoutDuration(max(LEAST_MS, rest) if hours.closed.all() else timer)

    clean = F.when(~F.isnan(value), F.col(value)).cast("double")
    rows = feed.select(
        F.col(ts).cast("timestamp").alias("ts"), F.col(id).cast("long").alias("id"), clean.alias("value"),
        F.col(tb).cast("double").alias("tb"),
    ).withWatermark("ts", delay)
    share = F.coalesce(F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(shares))), F.lit(NOBODY))
    return (
        # Missing ids have a share to themselves; a column without nulls keeps all digits in pandas.
        rows.withColumns({"start": F.date_trunc("hour", "ts"), "share": share.cast("int")})
        .withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
        .groupBy("start", "share")
        .applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


#: Timers ask for one empty batch after the other; a run to the present end stops at the data instead.
NO_EMPTY_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}

#: Open hours are many small states: they are kept on disk, and checkpoints carry changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start_closing(feed: DataFrame, out_path: str, checkpoint: str, trigger: dict, **options):
    """Start the query: closed hours under ``hours``, late readings under ``late``, a folder a batch.

    A batch that is run again replaces what it wrote.
    """
    spark = feed.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            hours = kept.where("NOT late").select("start", "id", "p95", "tb", "n")
            hours.write.mode("overwrite").parquet(f"{out_path}/hours/epoch={epoch}")
            late = kept.where("late").select("start", "id", "ts", "value", "tb")
            late.write.mode("overwrite").parquet(f"{out_path}/late/epoch={epoch}")
        finally:
            kept.unpersist()

    settings = STATE_STORE | (NO_EMPTY_BATCHES if "availableNow" in trigger else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, text in settings.items():
        spark.conf.set(key, text)
    try:
        return (
            closing_hours(feed, **options)
            .writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .foreachBatch(write)
            .start()
        )
    finally:
        for key, text in before.items():
            spark.conf.unset(key) if text is None else spark.conf.set(key, text)


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    return spark.read.format("statestore").load(checkpoint).select("key.start", "key.share", "value.groupState.*")


def open_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open hours in a query's state: ``start``, ``id``, when they were last fed, values and sums."""
    rows = _state(spark, checkpoint).select("*", F.posexplode("ids").alias("i", "id"))
    at = F.get("at", F.col("i"))
    run = [at + 1, F.get("at", F.col("i") + 1) - at]
    return rows.where(~F.get("closed", F.col("i"))).select(
        "start", F.when(F.col("share") != NOBODY, F.col("id")).alias("id"),
        *[F.slice(c, *[n.cast("int") for n in run]).alias(c) for c in ("vals", "counts")],
        *[F.get(c, F.col("i")).alias(c) for c in ("last", "s", "k", "n")],
    )


def drain(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped query would still have to say: its open hours as closed ones.

    Meant for a feed that has ended. The state isn't changed, so a query that is
    started again goes on with these hours.
    """
    names = ["start", "id", "p95", "tb", "n"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for start, share, held in zip(part["start"], part["share"], part[list(TYPES)].itertuples(index=False)):
                hours = Hours(tuple(held))
                out.append(hours.rows(start, share, ~hours.closed)[names])
            if out:
                yield pd.concat(out, ignore_index=True)

    return _state(spark, checkpoint).mapInPandas(run, "start timestamp, id long, p95 double, tb double, n long")


def run_to_end(feed: DataFrame, out_path: str, checkpoint: str, **options) -> DataFrame:
    """All hours of a feed that has ended: closed on the way, or drained."""
    spark = feed.sparkSession
    start_closing(feed, out_path, checkpoint, {"availableNow": True}, **options).awaitTermination()
    schema = "start timestamp, id long, p95 double, tb double, n long, epoch long"
    done = spark.read.schema(schema).parquet(f"{out_path}/hours").drop("epoch")
    return done.unionByName(drain(spark, checkpoint))
