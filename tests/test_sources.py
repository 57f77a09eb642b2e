"""Sources, sinks and the streaming feed."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ectolog import sources
from ectolog.sources import schemas
from ectolog.sources.readers import clean_name, sanitise
from ectolog.stats import mixed
from ectolog.streaming.hourly import stream_hourly


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿date_time,tb,model\n27/11/18 15:05,33,32\n", encoding="utf-8")
    row = sources.read_csv(spark, str(path), schemas.CALIBRATION).first()
    assert tuple(row) == ("27/11/18 15:05", 33.0, 32.0)


def test_csv_text_keeps_digits(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('Model,DF\n"a, b",2756.350\n')
    assert tuple(sources.read_csv_text(spark, str(path), ["model", "df"]).first()) == ("a, b", "2756.350")


def test_names():
    assert clean_name("Num. Par") == "num_par" and clean_name(" Dev.Expl(%) ") == "dev_expl"


def test_sanitise(spark):
    df = spark.createDataFrame([(1, 2)], "`Model id` int, `Delt_AIC` int")
    assert sanitise(df).columns == ["model_id", "delt_aic"]


def test_snapshot_partitions(spark, tmp_path):
    df = spark.range(20).withColumn("season", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    sources.write_snapshot(df, str(tmp_path / "s"), ["season"])
    back = sources.read_snapshot(spark, str(tmp_path / "s"), ["id", "season"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert (tmp_path / "s" / "season=a").exists()


def test_history_row(spark, tmp_path):
    df = spark.createDataFrame([(True, 1, 0, 0.30755), (False, 0, 1, 0.0)], "s boolean, m int, f int, x double")
    row = sources.history_rows(F.col("s"), [F.col("m"), F.col("f")], [F.col("x")])
    sources.write_history(df, row, str(tmp_path / "h"))
    got = sorted(r[0] for r in spark.read.text(str(tmp_path / "h")).collect())
    assert got == ["10\t1\t0\t0.308;", "11\t0\t1\t0;"]


def test_model_tables(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.repeat(np.arange(10), 6), "sex": np.tile(["a", "b"], 30)})
    pdf["y"] = rng.normal(size=60)
    fit = mixed.fit_random_intercept(spark.createDataFrame(pdf), "y", {"sex": ["a", "b"]}, rounds=1)
    sources.save_model(fit.tables(spark), str(tmp_path / "m"))
    back = sources.load_model(spark, str(tmp_path / "m"), ["coefficients", "covariance", "summary"])
    coef = {r["term"]: r["estimate"] for r in back["coefficients"].collect()}
    assert coef["(intercept)"] == float(fit.beta[0])
    assert back["covariance"].count() == 4


def _feed(minutes, base="2024-01-01 00:00:00"):
    ts = pd.Timestamp(base) + pd.to_timedelta(minutes, unit="m")
    k = np.arange(len(minutes))
    return pd.DataFrame({"ts": ts, "id": k % 3, "ms2": np.sqrt(k % 11), "tb": 20.0 + k % 5})


def test_stream_over_two_runs_equals_batch(spark, tmp_path):
    """The second run resumes: each closed hour is written once, late rows are dropped."""
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    schema = "ts timestamp_ntz, id long, ms2 double, tb double"
    first, second = _feed(np.arange(0, 600, 2)), _feed(np.arange(600, 1200, 2))
    late = _feed(np.array([1.0, 3.0]))

    def add(pdf):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream_hourly(spark.readStream.schema(schema).parquet(src), out, state)

    add(first)
    run()
    before = spark.read.parquet(out).count()
    add(pd.concat([second, late]))
    run()
    got = spark.read.parquet(out).toPandas()
    assert len(got) > before
    assert not got.duplicated(["start", "id"]).any()
    whole = pd.concat([first, second])
    whole["start"] = whole["ts"].dt.floor("h")
    last = whole["ts"].max() - pd.Timedelta(hours=2)
    closed = whole[whole["start"] + pd.Timedelta(hours=1) <= last]
    want = closed.groupby(["start", "id"]).agg(
        p95=("ms2", lambda v: np.quantile(v, 0.95)), tb=("tb", "mean")
    ).reset_index()
    both = got.merge(want, on=["start", "id"], suffixes=("", "_want"))
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["p95"], both["p95_want"]) and np.allclose(both["tb"], both["tb_want"])
