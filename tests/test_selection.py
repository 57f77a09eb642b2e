"""Exact selection by digits, and sketches that are kept."""

import math

import numpy as np
from pyspark.sql import functions as F

from ectolog.operators import selection, sketches

QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def numbers(df, key="k"):
    return {r[key]: [r[f"q{round(100 * p)}"] for p in QUARTERS] for r in df.collect()}


def test_order_of_bits(spark):
    values = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, math.inf]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "v double")
    found = df.orderBy(selection.ordered_bits(F.col("v"))).collect()
    assert [r[0] for r in found] == values
    odd = spark.createDataFrame([(-0.0,), (0.0,), (math.nan,), (None,)], "v double")
    assert [r[0] for r in odd.select(selection.ordered_bits(F.col("v"))).collect()] == [0, 0, None, None]


def test_quantiles_of_any_doubles(spark):
    rng = np.random.default_rng(1)
    wild = rng.normal(size=600) * 10.0 ** rng.integers(-300, 290, 600)
    ties = -rng.integers(0, 5, 400).astype(float)
    rows = [("ab"[i % 2], float(v)) for i, v in enumerate(np.concatenate([wild, ties, [-0.0, 0.0, 5e-324]]))]
    rows += [(None, float(v)) for v in rng.normal(size=101)] + [("one", 7.0), ("none", None), ("none", math.nan)]
    found = numbers(selection.five_number_by_digits(spark.createDataFrame(rows, "k string, x double").repartition(4), "x", ["k"]))
    assert set(found) == {"a", "b", None, "one", "none"} and found["none"] == [None] * 5
    for k in ("a", "b", None, "one"):
        want = np.quantile([v for g, v in rows if g == k], QUARTERS)
        assert np.allclose(found[k], want, rtol=1e-13, atol=0)


def test_weights_and_no_keys(spark):
    rows = [(1.0, 3), (5.0, 0), (2.0, 1), (9.0, 2), (None, 4)]
    df = spark.createDataFrame(rows, "x double, w long")
    found = selection.quantiles_by_digits(df, [], "x", {"m": 0.5, "h": 0.9}, weight=F.col("w")).first()
    assert tuple(found) == tuple(np.quantile([1, 1, 1, 2, 9, 9], [0.5, 0.9]))
    empty = selection.five_number_by_digits(df.where("false"), "x").collect()
    assert empty == []


def test_a_million_close_values_are_not_ranked_in_one_task(spark):
    """All values lie in one narrow range; no task sorts more than a small part of them."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select((F.lit(30.0) + F.col("id") * 1e-9).alias("x"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("digits", "digits")
    found = selection.five_number_by_digits(df, "x").first()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tracker.getJobIdsForGroup("digits")
    want = np.quantile(30.0 + np.arange(n) * 1e-9, QUARTERS)
    assert np.allclose(list(found), want, rtol=1e-15)
    # Windows run over counts of one digit: at most 65,536 a range.
    bits = df.select(selection.ordered_bits(F.col("x")).alias("b"))
    for above, shift in zip((64, *selection.SHIFTS), selection.SHIFTS):
        top = F.shiftright("b", above) if above < 64 else F.lit(0)
        sizes = bits.select(top.alias("t"), F.shiftright("b", shift).alias("d")).distinct().groupBy("t").count()
        assert sizes.agg(F.max("count")).first()[0] <= 1 << 16


def test_merged_sketches_are_near(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i % 50), "ab"[i % 2], float(v)) for i, v in enumerate(rng.gamma(2, 3, 40_000))]
    rows += [(1, "a", None), (1, "a", math.nan), (99, "c", None)]
    df = spark.createDataFrame(rows, "hour int, k string, x double").repartition(6)
    sketches.quantile_sketches(df, ["k", "hour"], "x").write.parquet(str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    merged = sketches.merge_sketches(kept, ["k"])
    found = sketches.sketched_quantiles(merged, {"p50": 0.5, "p95": 0.95})
    assert {r["k"]: r["n"] for r in found.collect()} == {"a": 20_000, "b": 20_000}
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        off = sketches.off_by(df, ["k"], "x", found, name, p).collect()
        assert len(off) == 2 and max(r["off"] for r in off) <= sketches.rank_error()
    # Merging in two steps holds as well.
    two = sketches.merge_sketches(sketches.merge_sketches(kept.withColumn("part", F.col("hour") % 7), ["k", "part"]), ["k"])
    off = sketches.off_by(df, ["k"], "x", sketches.sketched_quantiles(two, {"p95": 0.95}), "p95", 0.95).collect()
    assert max(r["off"] for r in off) <= 2 * sketches.rank_error()
