"""Whole analyses and the streaming feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ectolog import functions as X
from ectolog import sources
from ectolog.functions.columns import MODEL_TO_CARCASS
from ectolog.operators import joins
from ectolog.operators.joins import PUBLISHED_BANDS as BANDS
from ectolog.plans import activity, effectiveness, field, habitat, performance, tset
from ectolog.session import scratch_path
from ectolog.stats.compare import aicc_weights
from ectolog.stats.survival import survival_models
from ectolog.streaming.closing import run_to_end
from ectolog.streaming.hourly import stream_hourly as run_stream
from ectolog.workload.basic import _HISTORY, _round3_sql, deviation_sql
from ectolog.workload.registry import query
from ectolog.workload.relational import (
    _PROFILE,
    CURVE,
    FLAG,
    MIN_DAYS,
    TB,
    _by_sex,
    curve,
    with_tb,
)
from ectolog.workload.views import field_log

# ---- field log -------------------------------------------------------------

_DAYLIGHT = "hr >= 5 AND hr <= 21 AND date <= DATE '2024-01-28'"
_CLEAN = f"""days AS (SELECT id, count(DISTINCT date) AS days FROM fieldlog WHERE {_DAYLIGHT} GROUP BY id),
    clean AS (SELECT * FROM fieldlog WHERE {_DAYLIGHT}
              AND id IN (SELECT id FROM days WHERE days >= {MIN_DAYS - 4}))"""


def clean_log(v):
    return field.field_tb(v.fieldlog, until="2024-01-28", min_days=MIN_DAYS - 4)


@query(
    "pipe_field_tb",
    f"""WITH {_CLEAN} SELECT id, sex, D{{date}} AS date, I{{hr}} AS hr, month, season, R{{{TB}}} AS tb,
        R{{sqrt(x_ms2 + y_ms2)}} AS ms2 FROM clean""",
)
def pipe_field_tb(v):
    return clean_log(v).select("id", "sex", "date", "hr", "month", "season", "tb", "ms2")


_HOUR_TB = f"""hour_tb AS (SELECT id, date, hr, season, sex, avg({TB}) AS tb FROM seasonlog
               WHERE sex <> 'ZZf' GROUP BY id, date, hr, season, sex)"""


@query(
    "pipe_accuracy",
    f"""WITH {_HOUR_TB} SELECT id, D{{date}} AS date, I{{hr}} AS hr, season, sex,
        R{{{_by_sex('tb')}}} AS individual_db, R{{tb}} AS tb, monthname(date) AS month FROM hour_tb""",
)
def pipe_accuracy(v):
    return field.accuracy(with_tb(v.seasonlog))


@query(
    "pipe_accuracy_daily",
    f"""WITH day AS (SELECT id, date, season, sex, avg({TB}) AS tb FROM fieldlog WHERE sex <> 'ZZf'
                     GROUP BY id, date, season, sex),
        seen AS (SELECT DISTINCT id, date, hr FROM fieldlog)
        SELECT id, D{{date}} AS date, I{{hr}} AS hr, season, sex, R{{{_by_sex('tb')}}} AS individual_db,
               R{{tb}} AS tb, monthname(date) AS month FROM day JOIN seen USING (id, date)""",
)
def pipe_accuracy_daily(v):
    return field.accuracy(with_tb(v.fieldlog), grain="day")


# ---- habitat and effectiveness ---------------------------------------------


def _round2_sql(x: str) -> str:
    return _round3_sql(x).replace("1000.0", "100.0")


_RAW_TE = f"({MODEL_TO_CARCASS[0]} + te * {MODEL_TO_CARCASS[1]})"
_TE = f"""cal AS (SELECT model_id, type, date, hr, season, {_round2_sql(_RAW_TE)} AS te FROM envlog
          WHERE hr >= 5 AND hr <= 21 AND date < DATE '2001-09-01'),
    devs AS ({' UNION ALL '.join(
        f"SELECT *, 'de_{s}' AS analysis, {deviation_sql('te', *b)} AS de FROM cal" for s, b in BANDS.items()
    )}),
    quality AS (SELECT date, type, model_id, hr, season, analysis, avg(te) AS te, avg(de) AS de,
                avg(CASE WHEN de >= 0.5 THEN 0 ELSE 1 END) AS ex FROM devs
                GROUP BY date, type, model_id, hr, season, analysis)"""


def quality(v):
    return habitat.habitat(v.envlog, before="2001-09-01")


@query(
    "pipe_habitat",
    f"""WITH {_TE} SELECT D{{date}} AS date, type, model_id, I{{hr}} AS hr, season, analysis, R{{te}} AS te,
        R{{de}} AS de, R{{ex}} AS ex, monthname(date) AS month FROM quality""",
)
def pipe_habitat(v):
    return quality(v)


@query(
    "pipe_effectiveness",
    f"""WITH {_TE}, {_HOUR_TB},
        de AS (SELECT analysis, season, avg(de) AS de_season FROM quality GROUP BY analysis, season),
        db AS (SELECT id, season, sex, avg({_by_sex('tb')}) AS db_mean FROM hour_tb GROUP BY id, season, sex)
        SELECT db.sex, db.season, id, R{{db_mean}} AS db_mean, R{{de_season}} AS de_season,
               R{{CASE WHEN de_season <> 0 THEN 1 - db_mean / de_season END}} AS e_index
        FROM db JOIN de ON de.analysis = 'de_' || db.sex AND de.season = db.season""",
)
def pipe_effectiveness(v):
    return effectiveness.effectiveness(field.deviations(with_tb(v.seasonlog)), quality(v))


_CUT, _FROM = joins.TRUNCATED_BANDS, joins.TRUNCATED_ORIGINS


def _cut_by_sex(x: str) -> str:
    arms = " ".join(
        f"WHEN '{s}' THEN ({deviation_sql(x, *b, _FROM[s])})" for s, b in _CUT.items()
    )
    return f"CASE sex {arms} END"


_PUBLISHED_TE = _TE.split("devs AS")[0] + f"""devs AS ({' UNION ALL '.join(
    f"SELECT *, 'de_{s}' AS analysis, {deviation_sql('te', *b, _FROM[s])} AS de FROM cal"
    for s, b in _CUT.items())}),
    quality AS (SELECT date, type, model_id, hr, season, analysis, avg(de) AS de FROM devs
                GROUP BY date, type, model_id, hr, season, analysis)"""


@query(
    "pipe_effectiveness_published",
    f"""WITH {_PUBLISHED_TE},
        day AS (SELECT id, date, season, sex, avg({TB}) AS tb FROM seasonlog WHERE sex <> 'ZZf'
                GROUP BY id, date, season, sex),
        seen AS (SELECT DISTINCT id, date, hr FROM seasonlog),
        hour_tb AS (SELECT * FROM day JOIN seen USING (id, date)),
        de AS (SELECT analysis, season, round_even(avg(de), 2) AS de_season FROM quality GROUP BY analysis, season),
        db AS (SELECT id, season, sex, avg({_cut_by_sex('tb')}) AS db_mean FROM hour_tb GROUP BY id, season, sex)
        SELECT db.sex, db.season, id, R{{db_mean}} AS db_mean, R{{de_season}} AS de_season,
               R{{CASE WHEN de_season <> 0 THEN 1 - db_mean / de_season END}} AS e_index
        FROM db JOIN de ON de.analysis = 'de_' || db.sex AND de.season = db.season""",
)
def pipe_effectiveness_published(v):
    db = field.deviations(with_tb(v.seasonlog), _CUT, _FROM, grain="day")
    de = habitat.habitat(v.envlog, "2001-09-01", _CUT, _FROM)
    return effectiveness.effectiveness(db, de, decimals=2)


# ---- activity, performance, set-points -------------------------------------


@query(
    "pipe_activity",
    f"""WITH minutes AS (SELECT date, hr, id, sex, season, CAST(sum({FLAG}) AS BIGINT) AS freq,
        avg(tsurf) AS temp FROM fieldlog WHERE sex <> 'ZZf' GROUP BY date, hr, id, sex, season)
        SELECT season, sex, I{{hr}} AS hr, {_PROFILE} FROM minutes GROUP BY season, sex, hr""",
)
def pipe_activity(v):
    return activity.activity(v.fieldlog)


@query(
    "pipe_performance",
    f"""WITH {CURVE} SELECT id, sex, season, R{{avg(tb)}} AS topt, R{{max(p95)}} AS pmax FROM (
          SELECT id, sex, season, tb, round(p95, 9) AS p95,
                 max(round(p95, 9)) OVER (PARTITION BY id, sex, season) AS top FROM curve)
        WHERE p95 = top GROUP BY id, sex, season""",
)
def pipe_performance(v):
    return performance.performance(curve(v))


@query(
    "binned_curve",
    f"""WITH {CURVE} SELECT id, season, sex, R{{temp}} AS temp, R{{p95}} AS p95, R{{tb}} AS tb
        FROM curve WHERE sex <> 'ZZf'""",
)
def binned_curve(v):
    return performance.binned_curve(with_tb(v.seasonlog))


_WIDE = ", ".join(
    f"R{{max(CASE WHEN sex = '{s}' THEN {c} END)}} AS {c}_{s}"
    for s in ("ZZf", "ZWf", "ZZm")
    for c in ("mean", "se")
)


@query(
    "pipe_tset_table",
    f"""WITH iqr AS (SELECT id, sex, avg(tsurf) AS m, quantile_cont(tsurf, 0.75) - quantile_cont(tsurf, 0.25) AS i
                     FROM seasonlog GROUP BY id, sex),
        long AS (SELECT sex, '25% quantile' AS gradient_index, m - i / 2 AS x FROM iqr
                 UNION ALL SELECT sex, 'Mean', m FROM iqr
                 UNION ALL SELECT sex, '75% quantile', m + i / 2 FROM iqr),
        cell AS (SELECT gradient_index, sex, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS ss
                 FROM long GROUP BY gradient_index, sex),
        pool AS (SELECT gradient_index, sum(ss) / (sum(n) - count(*)) AS v FROM cell GROUP BY gradient_index),
        fit AS (SELECT gradient_index, sex, mean, sqrt(v / n) AS se FROM cell JOIN pool USING (gradient_index))
        SELECT gradient_index, {_WIDE} FROM fit GROUP BY gradient_index""",
)
def pipe_tset_table(v):
    return tset.tset_table(v.seasonlog, "tsurf")


# ---- survival --------------------------------------------------------------

DEV = "-2 * (CASE WHEN s > 0 THEN s * ln(s / n) ELSE 0 END + CASE WHEN n > s THEN (n - s) * ln((n - s) / n) ELSE 0 END)"
SURV_MODELS = f"""cell AS (SELECT sex, CAST(count(*) AS DOUBLE) AS n,
                 CAST(sum(CASE WHEN survived THEN 1 ELSE 0 END) AS DOUBLE) AS s FROM survlog GROUP BY sex),
    whole AS (SELECT sum(n) AS n, sum(s) AS s FROM cell),
    models AS (SELECT 'const' AS model, {DEV} AS deviance, 1 AS k, n FROM whole
               UNION ALL SELECT 'sex', (SELECT sum({DEV}) FROM cell), (SELECT count(*) FROM cell), n FROM whole),
    scored AS (SELECT *, deviance + 2 * k + 2 * k * (k + 1) / (n - k - 1) AS aicc FROM models),
    diffs AS (SELECT *, aicc - min(aicc) OVER () AS delta_aicc FROM scored),
    lik AS (SELECT *, exp(-delta_aicc / 2) AS likelihood FROM diffs)"""
WEIGHTS = """R{aicc} AS aicc, R{delta_aicc} AS delta_aicc, R{likelihood / sum(likelihood) OVER ()} AS weight,
             R{likelihood} AS likelihood, I{k} AS k, R{deviance} AS deviance"""


@query("pipe_survival", f"WITH {SURV_MODELS} SELECT model, {WEIGHTS} FROM lik")
def pipe_survival(v):
    return aicc_weights(survival_models(v.survlog, "survived", "sex"))


@query("pipe_survival_histories", _HISTORY.format(trait=_round3_sql("trait")))
def pipe_survival_histories(v):
    dummies = [F.when(F.col("sex") == s, 1).otherwise(0) for s in ("ZZm", "ZWf")]
    row = sources.history_rows(F.col("survived"), dummies, [F.col("trait")])
    return v.survlog.select(row.alias("value"))


# ---- streaming -------------------------------------------------------------


@query(
    "stream_hourly",
    f"""SELECT T{{date_trunc('hour', ts)}} AS start, T{{date_trunc('hour', ts) + INTERVAL 1 HOUR}} AS "end", id,
        R{{quantile_cont(sqrt(x_ms2 + y_ms2), 0.95)}} AS p95, R{{avg({TB})}} AS tb
        FROM fieldlog WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR
              <= (SELECT max(ts) - INTERVAL 2 HOUR FROM fieldlog)
        GROUP BY date_trunc('hour', ts), id""",
)
def stream_hourly(v):
    out = scratch_path(v.spark, "stream_out")
    run_stream(_live(v), out, scratch_path(v.spark, "stream_state"))
    return v.spark.read.parquet(out).drop("epoch")


def _live(v):
    """The field log as a feed that is read file by file."""
    schema = v.table("events").schema
    feed = field_log(
        v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    )
    feed = with_tb(feed).withColumn("ms2", X.movement_vector(F.col("x_ms2"), F.col("y_ms2")))
    return feed.select("ts", "id", "ms2", "tb")


@query(
    "stream_hourly_all",
    f"""SELECT T{{date_trunc('hour', ts)}} AS start, id,
        R{{quantile_cont(sqrt(x_ms2 + y_ms2), 0.95)}} AS p95, R{{avg({TB})}} AS tb, I{{count(*)}} AS n
        FROM fieldlog GROUP BY date_trunc('hour', ts), id""",
)
def stream_hourly_all(v):
    """Every hour of the feed, the last ones drained."""
    return run_to_end(_live(v), scratch_path(v.spark, "stream_out"), scratch_path(v.spark, "stream_state"))
