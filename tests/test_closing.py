"""Hours that close themselves, late readings, restarts and the drain."""

import time

import numpy as np
import pandas as pd

from ectolog.streaming import closing

SCHEMA = "ts timestamp_ntz, id long, ms2 double, tb double"


def feed(minutes, start="2024-01-01"):
    ts = pd.Timestamp(start) + pd.to_timedelta(minutes, unit="m")
    k = np.arange(len(minutes))
    return pd.DataFrame({"ts": ts, "id": k % 3, "ms2": np.sqrt(k % 11), "tb": 20.0 + k % 5})


def in_batch(rows):
    rows = rows.assign(start=rows["ts"].dt.floor("h"))
    by = rows.groupby(["start", "id"])
    out = by.agg(p95=("ms2", lambda v: v.dropna().quantile(0.95)), tb=("tb", "mean"), n=("ts", "size"))
    return out.reset_index()


def same(got, want):
    got, want = (x.sort_values(["start", "id"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in ("start", "id", "n"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all()
    for c in ("p95", "tb"):
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-12, equal_nan=True)


class Place:
    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.src, self.out, self.state = (str(tmp_path / d) for d in ("src", "out", "state"))

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.src)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.src)

    def read(self, kind, schema):
        rows = self.spark.read.schema(schema).parquet(f"{self.out}/{kind}").toPandas()
        return rows

    def hours(self):
        return self.read("hours", "start timestamp, id long, p95 double, tb double, n long")

    def late(self):
        return self.read("late", "start timestamp, id long, ts timestamp, value double, tb double")

    def run(self, **options):
        closing.start_closing(self.stream(), self.out, self.state, {"availableNow": True}, **options).awaitTermination()


def test_ended_feed_equals_batch(spark, tmp_path):
    place = Place(spark, tmp_path)
    rows = feed(np.arange(0, 700, 2))
    rows.loc[rows.index[:40], "ms2"] = np.nan
    rows.loc[rows.index[30:60], "tb"] = None
    place.add(rows)
    same(closing.run_to_end(place.stream(), place.out, place.state).toPandas(), in_batch(rows))


def test_restart_closes_once_and_late_rows_stand_apart(spark, tmp_path):
    place = Place(spark, tmp_path)
    first, second = feed(np.arange(0, 300, 2)), feed(np.arange(300, 900, 2))
    place.add(first)
    place.run(poll_ms=1)
    assert len(place.hours()) == 0
    # Timers that are due fire in the next run: what the watermark has passed closes.
    place.add(second)
    place.run(poll_ms=1)
    closed = place.hours()
    assert 0 < len(closed) and not closed.duplicated(["start", "id"]).any()
    # Readings of closed hours are late; those of open hours still count.
    open_before = closing.open_hours(spark, place.state).count()
    late, more = feed(np.array([1.0, 3.0, 5.0])), feed(np.array([890.0, 891.0, 892.0]))
    place.add(pd.concat([late, more]))
    place.run(poll_ms=1)
    found = place.late()
    assert sorted(found["ts"]) == sorted(late["ts"]) and np.allclose(sorted(found["value"]), sorted(late["ms2"]))
    rest = closing.drain(spark, place.state).toPandas()
    same(pd.concat([place.hours(), rest]), in_batch(pd.concat([first, second, more])))
    # Open hours are those behind the watermark, not the length of the feed.
    assert closing.open_hours(spark, place.state).count() <= open_before < len(in_batch(pd.concat([first, second])))


def test_feed_that_stops_closes_every_hour(spark, tmp_path):
    place = Place(spark, tmp_path)
    rows = feed(np.arange(0, 400, 4))
    place.add(rows)
    query = closing.start_closing(
        place.stream(), place.out, place.state, {"processingTime": "500 milliseconds"}, idle_ms=1000, poll_ms=200
    )
    try:
        want, until = in_batch(rows), time.time() + 90
        while time.time() < until:
            time.sleep(1)
            try:
                if len(place.hours()) >= len(want):
                    break
            except Exception:  # noqa: BLE001, S112 - nothing is written yet
                continue
        same(place.hours(), want)
    finally:
        query.stop()
    assert closing.open_hours(spark, place.state).count() == 0


def test_individuals_share_the_states_of_an_hour(spark, tmp_path):
    """A state an hour and individual costs milliseconds each; many individuals lie in a few."""
    place = Place(spark, tmp_path)
    k = np.arange(3000)
    rows = feed(k % 90).assign(id=(k % 1000) + 2**60)
    rows.loc[rows.index[:30], "ms2"] = np.nan
    place.add(rows)
    nobody = rows[:7].assign(id=None).astype({"id": "Int64"})
    rows_of = spark.createDataFrame([(t.to_pydatetime(), None, 1.0, 20.0) for t in nobody["ts"]], SCHEMA)
    rows_of.write.mode("append").parquet(place.src)
    got = closing.run_to_end(place.stream(), place.out, place.state)
    named = got.where("id IS NOT NULL").selectExpr("start", "id - 1152921504606846976 AS id", "p95", "tb", "n").toPandas()
    want = in_batch(rows.assign(id=rows["id"] - 2**60))
    same(named, want)
    assert [tuple(r) for r in got.where("id IS NULL").select("p95", "tb", "n").collect()] == [(1.0, 20.0, 7)]
    held = closing.open_hours(spark, place.state)
    assert held.count() == len(want) + 1
    assert held.where("size(vals) <> size(counts) OR aggregate(counts, 0L, (a, x) -> a + x) > n").isEmpty()
    states = spark.read.format("statestore").load(place.state).count()
    assert states <= 2 * (closing.SHARES + 1) < len(want)
