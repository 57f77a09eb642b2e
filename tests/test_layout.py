"""Quarantine of bad lines, replaced partitions, bucketed tables, day bitmaps."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ectolog import sources
from ectolog.operators import aggregate
from ectolog.workload.relational import bucketed_log, hourly_on_buckets
from ectolog.workload.views import Views


def test_bad_lines_stand_apart_once(spark, tmp_path):
    good, bad = [], []
    for k in range(3):
        lines = ["id,day,temp"]
        for i in range(40):
            line = f"{i + 100 * k},1/02/19,{i / 4}"
            if i % 10 == 3:
                line = [f"{i},1/02/19,hot", f"{i},1/02/19", f"x{i},1/02/19,1.0", f"{i},1/02/19,1,2"][k + i // 10 & 3] + " "
                bad.append((k, line))
            else:
                good.append((i + 100 * k, "1/02/19", i / 4))
            lines.append(line)
        (tmp_path / f"part{k}.csv").write_text("\n".join(lines) + "\n")
    found = sources.read_csv_checked(spark, str(tmp_path), "id int, day string, temp double")
    assert sorted(map(tuple, found.rows.collect())) == sorted(good)
    assert found.counts.get == {"lines": 120, "refused": len(bad)}
    refused = sorted((int(r["file"][-5]), r["line"]) for r in found.refused.collect())
    assert refused == sorted(bad)
    # Whatever columns are asked for, the same lines are good.
    assert found.rows.select("id").count() == found.rows.count() == len(good)
    assert found.rows.agg(F.sum("id")).first()[0] == sum(g[0] for g in good)


def digests(folder):
    return {p.relative_to(folder): hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.rglob("*.parquet")}


def test_rerun_of_one_date_leaves_the_others(spark, tmp_path):
    path = tmp_path / "snap"
    rows = spark.range(400).select(F.expr("date'2019-01-01' + int(id % 4)").alias("date"), "id")
    sources.replace_partitions(rows.repartition(7), str(path), ["date"])
    before = digests(path)
    assert len(before) == 4  # one file a date, whatever the number of tasks
    again = rows.where("id % 4 = 2").withColumn("id", F.col("id") + 1000)
    sources.replace_partitions(again, str(path), ["date"])
    after = digests(path)
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.parts[0] for p in same} == {f"date=2019-01-0{k}" for k in (1, 2, 4)} and len(after) == 4
    assert spark.read.parquet(str(path)).where("id >= 1000").count() == 100
    # A write that fails on its way changes nothing.
    broken = rows.withColumn("id", F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sources.replace_partitions(broken, str(path), ["date"])
    assert digests(path) == after and spark.read.parquet(str(path)).count() == 400


def test_bucketed_log_needs_no_exchange(spark, sf_dir):
    log = bucketed_log(Views(spark, sf_dir), "test", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hourly_on_buckets(log)
        rows = found.count()
        plan = hourly_on_buckets(log)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert rows == Views(spark, sf_dir).seasonlog.select("id", "date", "hr").distinct().count()


def test_days_of_halves_are_days_of_both(spark):
    rng = random.Random(3)
    day = dt.date(2018, 11, 27)
    rows = [(f"l{rng.randrange(6)}", day + dt.timedelta(rng.randrange(200))) for _ in range(900)]
    rows += [("old", dt.date(1, 1, 1)), ("old", dt.date(9999, 12, 31)), ("l1", None), (None, day), ("none", None)]
    table = spark.createDataFrame(rows, "id string, date date").repartition(5)
    halves = [aggregate.day_bitmaps(table.where(f"pmod(hash(id, date), 3) {c} 0")) for c in ("=", "<>")]
    overlap = aggregate.day_bitmaps(table.limit(100))
    merged = aggregate.merge_days(halves[0].unionByName(halves[1]).unionByName(overlap))
    found = {r["id"]: r["days"] for r in aggregate.days_of(merged).collect()}
    want = {r["id"]: r["days"] for r in aggregate.tracking_days(table).collect()}
    assert found == want and want["old"] == 2
    # A step at a time gives the same bitmaps.
    step = aggregate.merge_days(aggregate.merge_days(halves[1].unionByName(overlap)).unionByName(halves[0]))
    assert sorted(map(str, step.collect())) == sorted(map(str, merged.collect()))


def test_whole_numbers_keep_their_zeros(spark):
    df = spark.createDataFrame([(100.0,), (20.50,), (0.0,), (1234.0,)], "x double")
    for digits, want in ((0, {"100", "20", "0", "1234"}), (3, {"100", "20.5", "0", "1234"})):
        row = sources.history_rows(F.lit(True), [], [F.col("x")], digits=digits)
        assert {r[0].split("\t")[1][:-1] for r in df.select(row.alias("r")).collect()} == want


def test_batches_of_a_query_are_bounded_inside_only(spark):
    from ectolog.session import BATCH_ROWS, rows_at_a_time

    def largest():
        sizes = spark.range(0, 1_000, 1, 1).mapInPandas(
            lambda batches: (b[:1].assign(id=len(b)) for b in batches), "id long"
        )
        return max(r["id"] for r in sizes.collect())

    before = spark.conf.get(BATCH_ROWS, None)
    with rows_at_a_time(spark, 64):
        assert largest() == 64
    assert spark.conf.get(BATCH_ROWS, None) == before and largest() == 1_000


def test_partitions_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """A task's files are open at once, its rows aren't sorted; more partitions than that still come out whole."""
    from pyspark.sql.readwriter import DataFrameWriter

    from ectolog.sources import sinks

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **o: (seen.append(spark.conf.get(sinks.OPEN_FILES)), write(w, *a, **o))[1])
    rows = spark.range(4000).select((F.col("id") % 11).alias("part"), "id")
    before = spark.conf.get(sinks.OPEN_FILES, None)
    sources.replace_partitions(rows.repartition(5), str(tmp_path / "t"), ["part"])
    assert [int(n) for n in seen] == [sinks.MOST_OPEN] and spark.conf.get(sinks.OPEN_FILES, None) == before
    found = spark.read.parquet(str(tmp_path / "t"))
    assert found.count() == 4000 and found.where("id % 11 <> part").isEmpty()


def test_large_groupings_get_tasks_by_their_rows(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 24).alias("hr"))
    assert aggregate.dealt(rows, ["id"]) is rows
    many = aggregate.dealt(rows, ["id", "hr"], rows_a_task=200)
    assert many.rdd.getNumPartitions() == 25
    plan = many.groupBy("id", "hr").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert many.groupBy("id", "hr").count().where("count = 1").count() == 5000
