"""Hot groups, fallbacks beyond the broadcast bound, independence of partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ectolog.operators import aggregate, joins, quantiles, reshape
from ectolog.stats import anova, tails


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 4000
    ids = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 60, n)).astype(float)
    x = np.round(rng.normal(0, 30, n), 2)
    x[rng.random(n) < 0.05] = np.nan
    rows = [
        (None if i == 59 else int(i), int(k), None if rng.random() < 0.03 else float(v), float(v2))
        for k, (i, v, v2) in enumerate(zip(ids, x, rng.random(n), strict=True))
    ]
    rows += [(1000, n, None, 1.0), (1001, n + 1, 5.0, 2.0)]
    return spark.createDataFrame(rows, "id long, k long, x double, w double").repartition(5, "k")


def expected(pdf, probs):
    out = {}
    for key, grp in pdf.groupby("id", dropna=False):
        x = grp["x"].dropna().to_numpy()
        key = None if pd.isna(key) else int(key)
        out[key] = (
            [None] * len(probs) if not len(x) else [float(np.quantile(x, p)) for p in probs],
            float(grp["w"].mean()),
        )
    return out


@pytest.mark.parametrize("spread", [True, False])
def test_quantiles_by_brute_force(skewed, spread):
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = quantiles.quantile_by(
        skewed, ["id"], "x", probs, means={"w": F.col("w")}, spread=spread
    ).collect()
    want = expected(skewed.toPandas(), list(probs.values()))
    assert {r["id"] for r in got} == set(want)
    for r in got:
        values, mean = want[r["id"]]
        for name, value in zip(probs, values, strict=True):
            assert r[name] == (None if value is None else pytest.approx(value, abs=1e-9))
        assert r["w"] == pytest.approx(mean)


def test_quantile_ignores_partitioning(skewed):
    runs = [
        sorted(
            map(
                tuple,
                quantiles.quantile_by(df, ["id"], "x", {"p": 0.9}).collect(),
            ),
            key=str,
        )
        for df in (skewed, skewed.repartition(1), skewed.orderBy(F.desc("k")).repartition(7))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_quantile_ties_and_huge_values(spark):
    data = [(v,) for v in [1e307, -1e307, 0.0, -0.0, 5.0, 5.0, 5.0, 1e-9, -1e-9]]
    df = spark.createDataFrame(data, "x double")
    got = quantiles.five_number(df, "x").first()
    want = np.quantile([d[0] for d in data], [0, 0.25, 0.5, 0.75, 1])
    assert list(got) == pytest.approx(list(want), abs=1e-12)


def test_weights_count_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2)], "x double, c long")
    got = quantiles.quantile_by(df, [], "x", {"p": 0.4}, weight=F.col("c")).first()[0]
    assert got == pytest.approx(np.quantile([1, 1, 1, 2, 9, 9], 0.4))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_salted_join_equals_broadcast(spark, skewed, how, null_safe, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_OF_A_KEY", 50)
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (77, "c"), (None, "d")], "id long, t string")
    fact = skewed.select("id", "k")
    small = joins.attach(fact, dim, ["id"], how, null_safe=null_safe)
    large = joins.attach(fact, dim, ["id"], how, max_rows=0, null_safe=null_safe)
    assert small.columns == large.columns
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    matched = fact.filter(F.col("id").isNull()).count() if null_safe else 0
    if how == "inner":
        assert small.filter("id is null").count() == matched


def test_only_hot_keys_are_salted(spark, skewed, capsys):
    """A key over the bound is spread; without one, no lookup row is repeated."""
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    joins.salted_join(skewed, dim, ["id"], "inner", rows_of_a_key=50).explain()
    assert "_salt" in capsys.readouterr().out
    joins.attach(skewed, dim, ["id"], max_rows=0).explain()
    assert "_salt" not in capsys.readouterr().out


def test_broadcast_is_bounded_by_bytes(spark, skewed, capsys, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 1000)
    dim = spark.createDataFrame([(1, "a" * 2000)], "id long, t string")
    got = joins.attach(skewed, dim, ["id"])
    assert "ResolvedHint" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == skewed.where("id = 1").count()


def test_sums_of_squares_far_from_zero(spark):
    """Means of a million with a spread of a thousandth keep their digits."""
    rng = np.random.default_rng(7)
    g, y = rng.integers(0, 4, 5000), 1e6 + 1e-3 * rng.standard_normal(5000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, y)], "g long, y double")
    row = anova.anova_oneway(df, "y", "g").first()
    means = np.array([y[g == k].mean() for k in range(4)])
    sizes = np.array([(g == k).sum() for k in range(4)])
    want = (sizes * (means - y.mean()) ** 2).sum()
    assert row["ss_between"] == pytest.approx(want, rel=1e-3) and row["f"] > 0


def test_chi_square_tail_at_many_degrees():
    for k in (1e3, 1e5, 1e6, 1e7, 1e8):
        half = float(tails.chi2_sf(k, k))
        assert 0.49 < half < 0.5 and (k < 1e5 or half > 0.499)
    assert float(tails.chi2_sf(9990.0, 9999.0)) == pytest.approx(float(tails.chi2_sf(9990.0, 10001.0)), abs=0.02)
    assert float(tails.chi2_sf(3.841458820694124, 1.0)) == pytest.approx(0.05, abs=1e-12)


def test_carried_null_beside_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None), (3, "b")], "id long, sex string")
    good = aggregate.carry_unique(df.where("id > 1"), ["id"], ["sex"]).collect()
    assert {(r["id"], r["sex"]) for r in good} == {(2, None), (3, "b")}
    with pytest.raises(Exception, match="sex differs"):
        aggregate.carry_unique(df, ["id"], ["sex"]).collect()


def test_pairs_within_groups(spark):
    rows = [(g, k, float(10 * g + k + j)) for g in (1, 2) for k in range(3) for j in (0, 1)]
    df = spark.createDataFrame(rows, "g long, k long, y double")
    means = anova.fit_group_means(df, "y", "k", by=["g"])
    pairs = anova.pairwise_means(means, "k", p=True, by=["g"]).collect()
    assert len(pairs) == 6 and all(abs(r["estimate"]) <= 2 for r in pairs)


def test_operators_beyond_the_broadcast_bound(spark, skewed, monkeypatch):
    rows = skewed.select("id", "k", F.abs(F.round("w", 1)).alias("w"))
    near = [
        sorted(reshape.argmax_ties(rows, ["id"], "w").collect(), key=str),
        sorted(reshape.group_ci(rows, ["id"], "w", ci=False).collect(), key=str),
    ]
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    far = [
        sorted(reshape.argmax_ties(rows, ["id"], "w").collect(), key=str),
        sorted(reshape.group_ci(rows, ["id"], "w", ci=False).collect(), key=str),
    ]
    assert near[0] == far[0]
    assert [r[:3] for r in near[1]] == [r[:3] for r in far[1]]


def test_band_match_by_brute_force(spark, skewed):
    bands = spark.createDataFrame(
        [("a", -10.0, -2.0), ("b", -2.0, 0.0), ("c", 0.0, 41.3), ("d", 200.0, 300.0)],
        "band string, lower double, upper double",
    )
    pdf = skewed.select("k", "x").toPandas()
    want = sorted(
        (int(k), b) for b, lo, hi in [r[:3] for r in bands.collect()]
        for k, x in pdf.itertuples(index=False) if lo <= x <= hi
    )
    for bound in (10, 0):
        got = joins.band_match(skewed.select("k", "x"), bands, "x", width=7.0)
        assert sorted((r["k"], r["band"]) for r in got.collect()) == want, bound


def test_argmax_first_and_ties(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 30.0), ("a", 3.0, 25.0), ("a", 3.0, 20.0), ("b", None, 1.0), ("b", 2.0, 9.0)],
        "id string, fit double, temp double",
    )
    first = {r["id"]: r["temp"] for r in reshape.argmax_first(df, ["id"], "fit", ["temp"]).collect()}
    assert first == {"a": 20.0, "b": 9.0}
    assert reshape.argmax_ties(df, ["id"], "fit").count() == 3
    best = {r["id"]: (r["topt"], r["pmax"]) for r in reshape.topt_pmax(df, ["id"], tb="temp").collect()}
    assert best == {"a": (22.5, 3.0), "b": (9.0, 2.0)}


def test_minimum_days(spark):
    rows = [(i, f"2019-01-{d:02d}") for i, days in ((1, 7), (2, 6)) for d in range(1, days + 1)]
    rows += [(None, "2019-01-01")]
    df = spark.createDataFrame(rows, "id long, date string").withColumn("date", F.to_date("date"))
    kept = joins.keep_min_days(df, 7)
    assert {r["id"] for r in kept.collect()} == {1} and kept.count() == 7
    dropped = joins.keep_min_days(df, 7, keep=False)
    assert {r["id"] for r in dropped.collect()} == {2, None}


def test_replicated_hours(spark):
    df = spark.createDataFrame(
        [(1, "d", 5, "s", "x", 10.0), (1, "d", 5, "s", "x", 20.0), (1, "d", 23, "s", "x", 30.0),
         (1, "d", 0, "s", "x", 40.0)],
        "id long, date string, hr int, season string, sex string, tb double",
    )
    got = sorted((r["hr"], r["tb"]) for r in aggregate.replicate_unique(df).collect())
    assert got == [(0, 25.0), (5, 25.0), (23, 25.0)]


def test_carry_unique_guards(spark):
    ok = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, sex string")
    assert {tuple(r) for r in aggregate.carry_unique(ok, ["id"], ["sex"]).collect()} == {(1, "a"), (2, None)}
    bad = spark.createDataFrame([(1, "a"), (1, "b")], "id long, sex string")
    with pytest.raises(Exception, match="differs inside a group"):
        aggregate.carry_unique(bad, ["id"], ["sex"]).collect()


def test_single_row_spread_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "id long, x double")
    got = {r["id"]: r["se"] for r in aggregate.mean_se(df, "x", ["id"]).collect()}
    assert got[1] is None and got[2] == pytest.approx(1.0)


def test_sketch_quantiles_are_close(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    exact = {r["g"]: r["p"] for r in quantiles.quantile_by(df, ["g"], "x", {"p": 0.95}).collect()}
    near = {r["g"]: r["p"] for r in quantiles.approx_quantile_by(df, ["g"], "x", {"p": 0.95}).collect()}
    for g, v in exact.items():
        assert abs(near[g] - v) <= 20000 / 10_000 * 3


def test_no_cross_join_in_the_grid(spark, capsys):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    span = spark.createDataFrame([("a", 0.0, 9.0), ("b", 5.0, 6.0), ("zz", 0.0, 1.0)], "season string, lo double, hi double")
    grid = joins.grid_cross(ids, span, "season", {"sex": ["x", "y"], "season": ["a", "b"]}, steps=10)
    rows = grid.collect()
    assert len(rows) == 2 * 2 * 2 * 10
    assert sorted({r["temp"] for r in rows if r["season"] == "a"}) == [float(i) for i in range(10)]
    grid.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
