"""Published results."""

import pytest
from pyspark.sql import functions as F

from ectolog.functions import effectiveness_index
from ectolog.sources.sinks import history_rows
from ectolog.stats import compare, survival
from tests import golden


@pytest.fixture(scope="module")
def histories(spark):
    df = spark.createDataFrame(
        golden.HISTORIES,
        "history string, male int, female int, topt double, pmax double, e double, db double, act double",
    )
    return df.withColumn("survived", F.col("history") == "10").withColumn(
        "sex", F.when(F.col("male") == 1, "Male").otherwise("Female")
    )


def test_effectiveness(spark):
    df = spark.createDataFrame(golden.TRAITS, "sex string, db double, e double")
    de = F.when(F.col("sex") == "ZWf", golden.SPRING_DE["ZWf"]).otherwise(golden.SPRING_DE["ZZm"])
    gap = F.max(F.abs(effectiveness_index(F.col("db"), de) - F.col("e")))
    assert df.agg(gap).first()[0] < 1e-9


def test_survival_models(histories):
    models = survival.survival_models(histories, "survived", "sex")
    got = {r["model"]: r for r in compare.aicc_weights(models).collect()}
    assert got["const"]["deviance"] == pytest.approx(32.82, abs=0.005)
    assert got["const"]["aicc"] == pytest.approx(34.98, abs=0.005)
    assert got["sex"]["deviance"] == pytest.approx(30.81, abs=0.005)
    assert got["sex"]["aicc"] == pytest.approx(35.31, abs=0.005)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1.0)


@pytest.mark.parametrize(
    ("trait", "deviance", "aicc"), [("act", 33.82, 35.98), ("pmax", 34.36, 36.52)]
)
def test_sine_models(histories, trait, deviance, aicc):
    fit = survival.survival_glm(histories, "survived", {trait: F.col(trait)}, link="sine")
    assert fit.deviance == pytest.approx(deviance, abs=0.006)
    assert fit.aicc == pytest.approx(aicc, abs=0.006)


def test_curve_on_effectiveness(spark, histories):
    fit = survival.survival_glm(histories, "survived", {"e": F.col("e")}, link="sine")
    assert fit.coef[0] == pytest.approx(0.61277, abs=2e-5)
    grid = spark.createDataFrame([(p[0],) for p in golden.CURVE_ON_E], "e double")
    got = survival.survival_curve(grid, fit, {"e": F.col("e")}).orderBy("e").collect()
    for row, want in zip(got, golden.CURVE_ON_E, strict=True):
        assert tuple(row) == pytest.approx(want, abs=2e-5)


def test_curve_on_pmax_by_sex(spark, histories):
    terms = {"male": F.col("male"), "female": F.col("female"), "pmax": F.col("pmax")}
    fit = survival.survival_glm(histories, "survived", terms)
    assert list(fit.coef) == pytest.approx([13.3966, 9.1530, -913.2667], rel=1e-4)
    for sex, points in golden.CURVE_ON_PMAX.items():
        grid = spark.createDataFrame(
            [(p[0], int(sex == "Male"), int(sex == "Female")) for p in points],
            "pmax double, male int, female int",
        )
        got = survival.survival_curve(grid, fit, terms).orderBy("pmax").collect()
        for row, want in zip(got, points, strict=True):
            assert (row["survival"], row["se"], row["lci"], row["uci"]) == pytest.approx(
                want[1:], rel=2e-3, abs=2e-6
            )


def test_curve_model_identities(spark):
    fits = spark.createDataFrame(
        [(m[0], m[1], m[2], m[3], 892.1) for m in golden.CURVE_MODELS],
        "model string, resid_df double, resid_dev double, aic double, null_dev double",
    )
    got = compare.model_compare(fits, "a", "null_dev").collect()
    assert [r["model"] for r in got] == [m[0] for m in golden.CURVE_MODELS]
    for row, want in zip(got, golden.CURVE_MODELS, strict=True):
        assert row["delta_aic"] == pytest.approx(want[4], abs=0.006)
        assert row["dev_expl"] == pytest.approx(want[5], abs=0.02)


def test_logit_agrees_with_spark_ml(histories):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    ours = survival.survival_glm(
        histories, "survived", {"intercept": F.lit(1.0), "e": F.col("e"), "act": F.col("act")}
    )
    rows = VectorAssembler(inputCols=["e", "act"], outputCol="features").transform(
        histories.withColumn("label", F.col("survived").cast("double"))
    )
    model = GeneralizedLinearRegression(family="binomial", link="logit", tol=1e-10).fit(rows)
    assert ours.coef[0] == pytest.approx(model.intercept, rel=1e-5)
    assert list(ours.coef[1:]) == pytest.approx(list(model.coefficients), rel=1e-5)
    assert ours.deviance == pytest.approx(model.summary.deviance, rel=1e-8)


def test_other_optima_of_the_sine_link(histories):
    """The likelihood has lower optima far from 0; the reported one is the nearest."""
    fits = survival.survival_optima(
        histories, "survived", "pmax", F.col("pmax"), [0.0, 120.0, 200.0, 215.0, 230.0]
    )
    assert fits[0].coef[0] == pytest.approx(26.1, abs=0.1)
    assert fits[0].deviance == pytest.approx(34.36, abs=0.006)
    best = min(fits, key=lambda f: f.deviance)
    assert best.coef[0] == pytest.approx(213.9, abs=0.1)
    assert best.deviance == pytest.approx(27.06, abs=0.006)


def test_history_lines(spark, histories):
    """Rows of the published history file, character by character."""
    covariates = [F.col(c) for c in ("topt", "pmax", "e", "db", "act")]
    row = history_rows(F.col("survived"), [F.col("male"), F.col("female")], covariates)
    got = [r["v"] for r in histories.select(row.alias("v")).collect()]
    assert got == ["\t".join([h, *(f"{v:g}" for v in rest)]) + ";" for h, *rest in golden.HISTORIES]
    unknown = histories.withColumn("survived", F.lit(None).cast("boolean"))
    with pytest.raises(Exception, match="survival is not known"):
        unknown.select(row.alias("v")).collect()


def test_separated_survival_is_flagged(spark):
    df = spark.createDataFrame([(x > 5, float(x)) for x in range(11)], "survived boolean, x double")
    terms = {"one": F.lit(1.0), "x": F.col("x")}
    assert survival.survival_glm(df, "survived", terms).separated
    mixed_up = df.withColumn("survived", F.col("x") % 3 == 0)
    fit = survival.survival_glm(mixed_up, "survived", terms)
    assert fit.converged and not fit.separated and fit.iterations < 20
    assert not survival.survival_glm(mixed_up, "survived", terms, max_iter=1).converged
