"""Scalar functions on edge rows."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ectolog import functions as X
from ectolog.operators import joins


def values(spark, data, fn, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_deviation_edges(spark):
    got = values(
        spark,
        [20.0, 25.33, 28.0, 32.03, 33.0, None],
        lambda x: X.setpoint_deviation(x, 25.33, 32.03),
    )
    assert got == [pytest.approx(5.33), 0.0, 0.0, 0.0, pytest.approx(0.97), None]
    published = values(
        spark, [20.0, 26.0], lambda x: X.setpoint_deviation(x, 25.33, 32.03, 26.97309)
    )
    assert published == [pytest.approx(6.97309), 0.0]


def test_flags(spark):
    assert values(spark, [0.0, 0.49, 0.5, 3.0, None], X.in_range_flag) == [1, 1, 0, 0, None]
    assert values(spark, [-1.0, 0.0, 0.001, None], X.active_flag) == [0, 0, 1, None]


def test_round_half_even(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5, -1.5], X.round_half_even) == [0, 2, 2, 0, -2]
    two = values(spark, [0.125, 2.675, 1.005, -0.125, None], lambda x: X.round_half_even(x, 2))
    assert two == [0.12, 2.67, 1.0, -0.12, None]
    assert math.isnan(values(spark, [float("nan")], lambda x: X.round_half_even(x, 2))[0])


def test_signif(spark):
    got = values(spark, [123456.0, 0.0012345, -9.96, 0.0, None], lambda x: X.signif(x, 2))
    assert got == [pytest.approx(120000), pytest.approx(0.0012), pytest.approx(-10), 0.0, None]


def test_season_boundaries(spark):
    months = [f"2019-{m:02d}-01" for m in range(1, 13)]
    got = values(spark, months, lambda x: X.season_of(F.to_date(x)), "string")
    assert got == (
        ["Summer"] * 2 + ["Autumn"] * 3 + ["Winter"] * 3 + ["Spring"] * 3 + ["Summer"]
    )


def test_effectiveness_zero_habitat(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "db double, de double")
    got = [r[0] for r in df.select(X.effectiveness_index(F.col("db"), F.col("de"))).collect()]
    assert got == [0.5, None, None]


def test_labels(spark):
    assert values(spark, [0.001, 0.01, 0.0126, None], X.p_label) == ["<0.01", "0.010", "0.013", None]
    assert values(spark, ["Winter", "Spring", "x", None], X.level_rank, "string") == [4, 1, None, None]
    assert values(spark, [-1.0, 2.0, None], X.clamp_min) == [0.0, 2.0, None]
    ts = values(spark, ["1/09/19 05:03", "bad"], X.parse_ts, "string")
    assert str(ts[0]) == "2019-09-01 05:03:00" and ts[1] is None


def test_movement(spark):
    df = spark.createDataFrame([(9.0, 16.0), (-5.0, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(X.movement_vector(F.col("x"), F.col("y"))).collect()]
    assert got[0] == 5.0 and math.isnan(got[1])
    long = [r[0] for r in df.select(X.movement_vector(F.col("x"), F.col("y"), "euclid")).collect()]
    assert long[0] == pytest.approx(math.hypot(9, 16))


@settings(max_examples=15, deadline=None)
@given(
    data=st.lists(st.tuples(st.sampled_from(["ZWf", "ZZm", "ZZf"]), st.floats(-20, 70)), min_size=1)
)
def test_band_forms_agree(spark, data):
    """One expression for all sexes equals a branch per sex."""
    df = spark.createDataFrame(data, "sex string, tb double")
    both = joins.band_deviation(df, "tb")
    parts = None
    for sex, (lo, hi) in joins.PUBLISHED_BANDS.items():
        one = df.filter(F.col("sex") == sex).withColumn(
            "db", X.setpoint_deviation(F.col("tb"), lo, hi)
        )
        parts = one if parts is None else parts.unionByName(one)
    assert sorted(both.collect()) == sorted(parts.collect())
    for r in both.collect():
        lo, hi = joins.PUBLISHED_BANDS[r["sex"]]
        assert r["db"] >= 0 and (r["db"] == 0) == (lo <= r["tb"] <= hi)


def test_cell_text_rounds_the_stored_double(spark):
    df = spark.createDataFrame([(26.305, 0.585), (2.675, 0.125)], "m double, s double")
    got = [r[0] for r in df.select(X.mean_se_text(F.col("m"), F.col("s"))).collect()]
    assert got == ["%.2f (%.2f)" % (26.305, 0.585), "%.2f (%.2f)" % (2.675, 0.125)]
