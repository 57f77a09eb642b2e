"""Joins, aggregations, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ectolog import functions as X
from ectolog.functions.columns import SKIN_TO_BODY
from ectolog.operators import aggregate, clean, joins, quantiles, reshape, selection, sketches
from ectolog.operators.joins import PUBLISHED_BANDS as BANDS
from ectolog.session import scratch_path
from ectolog.sources import write_bucketed, write_snapshot
from ectolog.workload.basic import deviation_sql
from ectolog.workload.registry import query

TB = f"({SKIN_TO_BODY[0]} + tsurf * {SKIN_TO_BODY[1]})"
MIN_DAYS = 26


def with_tb(df):
    return df.withColumn("tb", X.calibrate_linear(F.col("tsurf"), *SKIN_TO_BODY))


def _by_sex(x: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN ({deviation_sql(x, *b)})" for s, b in BANDS.items())
    return f"CASE sex {arms} END"


DB_SQL = _by_sex(TB)

# ---- joins -----------------------------------------------------------------


@query(
    "join_obs_pred",
    """WITH obs AS (SELECT date, hr, avg(te) AS temp FROM envlog WHERE type = 'AO' GROUP BY date, hr),
       pred AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 17 + 5 AS INTEGER) AS hr,
                       o_totalprice / 10000.0 AS temp FROM orders)
       SELECT D{date} AS date, I{hr} AS hr, R{obs.temp} AS temp_observed, R{pred.temp} AS temp_predicted
       FROM obs JOIN pred USING (date, hr)""",
)
def join_obs_pred(v):
    return observed_predicted(v)


def observed_predicted(v):
    observed = (
        clean.filter_category(v.envlog, "type", keep=["AO"])
        .groupBy("date", "hr")
        .agg(F.avg("te").alias("temp"))
    )
    predicted = clean.distinct_rows(
        v.table("orders").select(
            F.to_date("o_orderdate").alias("date"),
            (F.col("o_orderkey") % 17 + 5).cast("int").alias("hr"),
            (F.col("o_totalprice") / 10000.0).alias("temp"),
        )
    )
    return joins.join_obs_pred(observed, predicted)


@query(
    "join_dim_de",
    """WITH de AS (SELECT sex, season, avg(tsurf) AS de_season FROM seasonlog GROUP BY sex, season),
       db AS (SELECT id, season, sex, avg(ms2) AS db_mean FROM seasonlog GROUP BY id, season, sex)
       SELECT id, season, sex, R{db_mean} AS db_mean, R{de_season} AS de_season
       FROM db JOIN de USING (sex, season)""",
)
def join_dim_de(v):
    de = v.seasonlog.groupBy("sex", "season").agg(F.avg("tsurf").alias("de_season"))
    db = v.seasonlog.groupBy("id", "season", "sex").agg(F.avg("ms2").alias("db_mean"))
    return joins.join_dim_de(db, de)


@query(
    "join_tset_band",
    f"""SELECT id, sex, R{{{TB}}} AS tb, R{{{DB_SQL}}} AS db FROM seasonlog WHERE sex <> 'ZZf'""",
)
def join_tset_band(v):
    return joins.band_deviation(with_tb(v.seasonlog.select("id", "sex", "tsurf")), "tb").drop("tsurf")


@query(
    "join_tset_band_table",
    """WITH band AS (SELECT sex, avg(tsurf) - 5 AS lo, avg(tsurf) + 5 AS hi FROM seasonlog GROUP BY sex)
       SELECT id, sex, R{tsurf} AS tsurf,
              R{CASE WHEN tsurf < lo THEN lo - tsurf WHEN tsurf > hi THEN tsurf - hi ELSE 0.0 END} AS db
       FROM seasonlog JOIN band USING (sex)""",
)
def join_tset_band_table(v):
    table = v.seasonlog.groupBy("sex").agg(
        (F.avg("tsurf") - 5).alias("lower"), (F.avg("tsurf") + 5).alias("upper")
    )
    return joins.bands_from_table(v.seasonlog.select("id", "sex", "tsurf"), table, "tsurf")


@query(
    "join_tset_band_all",
    " UNION ALL ".join(
        f"SELECT model_id, R{{te}} AS te, 'de_{s}' AS analysis, R{{{deviation_sql('te', *b)}}} AS de FROM envlog"
        for s, b in BANDS.items()
    ),
)
def join_tset_band_all(v):
    return joins.band_deviation_all(v.envlog.select("model_id", "te"), "te")


@query(
    "band_match",
    """WITH band AS (SELECT type, 26.0 + 0.5 * (row_number() OVER (ORDER BY type) - 1) AS lo,
                            avg(te) AS hi0 FROM envlog GROUP BY type),
       cut AS (SELECT type AS band, round(hi0, 1) - 4.0 AS lower, round(hi0, 1) + 3.0 AS upper FROM band)
       SELECT band, I{count(*)} AS n, R{avg(te)} AS te FROM envlog JOIN cut ON te BETWEEN lower AND upper
       GROUP BY band""",
)
def band_match(v):
    center = F.round(F.avg("te"), 1)
    bands = v.envlog.groupBy(F.col("type").alias("band")).agg(
        (center - 4.0).alias("lower"), (center + 3.0).alias("upper")
    )
    hit = joins.band_match(v.envlog.select("te"), bands, "te", width=2.0)
    return hit.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("te").alias("te"))


_DAYS = "SELECT id, count(DISTINCT date) AS days FROM fieldlog GROUP BY id"


@query(
    "keep_min_days",
    f"""SELECT id, D{{date}} AS date, I{{hr}} AS hr, R{{tsurf}} AS tsurf FROM fieldlog
        WHERE id IN (SELECT id FROM ({_DAYS}) WHERE days >= {MIN_DAYS})""",
)
def keep_min_days(v):
    kept = joins.keep_min_days(v.fieldlog, MIN_DAYS)
    return kept.select("id", "date", "hr", "tsurf")


@query(
    "keep_min_days_dropped",
    f"""SELECT DISTINCT id FROM fieldlog
        WHERE id NOT IN (SELECT id FROM ({_DAYS}) WHERE days >= {MIN_DAYS})""",
)
def keep_min_days_dropped(v):
    short = joins.keep_min_days(v.fieldlog.select("id", "date"), MIN_DAYS, keep=False)
    return short.select("id").distinct()


@query(
    "grid_cross",
    """WITH span AS (SELECT season, min(tsurf) AS lo, max(tsurf) AS hi FROM seasonlog GROUP BY season)
       SELECT id, sex, season, R{lo + (hi - lo) * i / 99.0} AS temp
       FROM (SELECT DISTINCT id FROM seasonlog) CROSS JOIN (SELECT unnest(['ZWf', 'ZZm']) AS sex)
       CROSS JOIN span CROSS JOIN (SELECT unnest(range(100)) AS i)""",
)
def grid_cross(v):
    return prediction_grid(v)


def prediction_grid(v):
    span = v.seasonlog.groupBy("season").agg(F.min("tsurf").alias("lo"), F.max("tsurf").alias("hi"))
    factors = {"sex": ["ZWf", "ZZm"], "season": list(X.columns.SEASONS)}
    ids = clean.distinct_values(v.seasonlog, "id")
    return joins.grid_cross(ids, span, "season", factors).select("id", "sex", "season", "temp")


@query(
    "bind_columns",
    """SELECT id, R{a.m} AS tsurf, R{b.m} AS ms2 FROM
       (SELECT id, avg(tsurf) AS m FROM seasonlog GROUP BY id) a
       JOIN (SELECT id, max(ms2) AS m FROM seasonlog GROUP BY id) b USING (id)""",
)
def bind_columns(v):
    a = v.seasonlog.groupBy("id").agg(F.avg("tsurf").alias("tsurf"))
    b = v.seasonlog.groupBy("id").agg(F.max("ms2").alias("ms2"))
    return joins.bind_columns(a, b, ["id"])


# ---- aggregations ----------------------------------------------------------


@query("mean_by", "SELECT id, sex, D{date} AS date, R{avg(tsurf)} AS tsurf FROM seasonlog GROUP BY id, sex, date")
def mean_by(v):
    return aggregate.mean_by(v.seasonlog, ["id", "sex", "date"], {"tsurf": "tsurf"})


@query(
    "strict_mean",
    """SELECT id, R{CASE WHEN count(x) = count(*) THEN avg(x) END} AS strict, R{avg(x)} AS skip
       FROM (SELECT id, type, CASE WHEN x <> 13 OR id % 2 = 0 THEN x END AS x FROM pairs) GROUP BY id""",
)
def strict_mean(v):
    holes = v.pairs.select("id", F.when((F.col("x") != 13) | (F.col("id") % 2 == 0), F.col("x")).alias("x"))
    means = aggregate.strict(F.avg("x"), F.col("x")).alias("strict"), F.avg("x").alias("skip")
    return holes.groupBy("id").agg(*means)


@query(
    "daily_minmaxmean",
    """SELECT D{date} AS date, season, R{max(te)} AS max, R{min(te)} AS min, R{avg(te)} AS mean
       FROM envlog GROUP BY date, season""",
)
def daily_minmaxmean(v):
    return aggregate.daily_minmaxmean(v.envlog, "te")


def _q(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


@query(
    "p95_hourly",
    f"""SELECT id, I{{hr}} AS hr, D{{date}} AS date, month, sex, season,
               R{{{_q('sqrt(x_ms2 + y_ms2)', 0.95)}}} AS p95, R{{avg({TB})}} AS tb
        FROM fieldlog GROUP BY id, hr, date, month, sex, season""",
)
def p95_hourly(v):
    log = with_tb(v.fieldlog).withColumn("ms2", X.movement_vector(F.col("x_ms2"), F.col("y_ms2")))
    return quantiles.p95_hourly(log)


@query(
    "p95_by_hour_season",
    f"""SELECT I{{hr}} AS hr, sex, season, R{{{_q('ms2', 0.95)}}} AS p95, R{{avg({TB})}} AS tb
        FROM seasonlog GROUP BY hr, sex, season""",
)
def p95_by_hour_season(v):
    return quantiles.p95_hourly(with_tb(v.seasonlog), keys=["hr", "sex", "season"], spread=True)


HOURLY = f"""hourly AS (SELECT id, hr, date, month, sex, season, {_q('ms2', 0.95)} AS p95, avg({TB}) AS tb
        FROM seasonlog GROUP BY id, hr, date, month, sex, season)"""
CURVE = f"""{HOURLY}, curve AS (SELECT * FROM (
        SELECT id, season, sex, round_even(tb, 0) AS temp, {_q('p95', 0.95)} AS p95, avg(tb) AS tb
        FROM hourly GROUP BY id, season, sex, round_even(tb, 0)) WHERE tb >= -4 AND tb <= 49)"""


def hourly(v):
    return quantiles.p95_hourly(with_tb(v.seasonlog))


def curve(v):
    return quantiles.p95_binned(hourly(v))


@query(
    "p95_binned",
    f"WITH {CURVE} SELECT id, season, sex, R{{temp}} AS temp, R{{p95}} AS p95, R{{tb}} AS tb FROM curve",
)
def p95_binned(v):
    return curve(v)


@query(
    "tset_by_group",
    f"""SELECT id, sex, R{{m}} AS mean_tb, R{{i}} AS iqr, R{{i / 2}} AS half_range,
               R{{m + i / 2}} AS upper, R{{m - i / 2}} AS lower
        FROM (SELECT id, sex, avg(tsurf) AS m, {_q('tsurf', 0.75)} - {_q('tsurf', 0.25)} AS i
              FROM seasonlog WHERE sex <> 'ZZf' GROUP BY id, sex)""",
)
def tset_by_group(v):
    lab = clean.filter_category(v.seasonlog, "sex", drop=["ZZf"])
    return quantiles.tset_by_group(lab, "tsurf")


@query(
    "five_number",
    "SELECT "
    + ", ".join(f"R{{{_q('te', p / 100)}}} AS q{p}" for p in (0, 25, 50, 75, 100))
    + " FROM envlog",
)
def five_number(v):
    return quantiles.five_number(v.envlog, "te")


@query(
    "five_number_by",
    "SELECT type, "
    + ", ".join(f"R{{{_q('te', p / 100)}}} AS q{p}" for p in (0, 25, 50, 75, 100))
    + " FROM envlog GROUP BY type",
)
def five_number_by(v):
    return quantiles.five_number(v.envlog, "te", ["type"])


@query(
    "std_error",
    "SELECT id, R{stddev_samp(tsurf) / sqrt(count(tsurf))} AS se FROM seasonlog GROUP BY id",
)
def std_error(v):
    return v.seasonlog.groupBy("id").agg(aggregate.std_error("tsurf").alias("se"))


@query(
    "mean_se",
    "SELECT R{avg(tsurf)} AS mean, R{stddev_samp(tsurf) / sqrt(count(tsurf))} AS se FROM seasonlog",
)
def mean_se(v):
    return aggregate.mean_se(v.seasonlog, "tsurf")


FLAG = "CASE WHEN acc <= 0 THEN 0 WHEN acc > 0 THEN 1 END"
MINUTES = f"""minutes AS (SELECT date, hr, id, sex, season, CAST(sum({FLAG}) AS BIGINT) AS freq,
              avg(tsurf) AS temp FROM seasonlog WHERE sex <> 'ZZf' GROUP BY date, hr, id, sex, season)"""


def minutes(v):
    return aggregate.active_minutes(clean.filter_category(v.seasonlog, "sex", drop=["ZZf"]))


@query(
    "active_minutes",
    f"WITH {MINUTES} SELECT D{{date}} AS date, I{{hr}} AS hr, id, sex, season, I{{freq}} AS freq, R{{temp}} AS temp FROM minutes",
)
def active_minutes(v):
    return minutes(v)


_PROFILE = "R{avg(temp)} AS tsurf, R{avg(freq)} AS movement_hr, R{stddev_samp(freq) / sqrt(count(freq))} AS se"


@query(
    "activity_profile",
    f"WITH {MINUTES} SELECT season, sex, I{{hr}} AS hr, {_PROFILE} FROM minutes GROUP BY season, sex, hr",
)
def activity_profile(v):
    return aggregate.activity_profile(minutes(v))


@query(
    "activity_by_id",
    f"WITH {MINUTES} SELECT season, sex, id, {_PROFILE} FROM minutes GROUP BY season, sex, id",
)
def activity_by_id(v):
    return aggregate.activity_by_id(minutes(v))


@query(
    "tracking_days",
    "SELECT id, I{count(DISTINCT date)} AS days FROM fieldlog GROUP BY id ORDER BY days, id",
)
def tracking_days(v):
    return clean.sort_by(aggregate.tracking_days(v.fieldlog), "days", "id")


@query(
    "sample_sizes",
    "SELECT season, I{count(*)} AS n FROM seasonlog GROUP BY season UNION ALL SELECT 'All', I{count(*)} FROM seasonlog",
)
def sample_sizes(v):
    return aggregate.sample_sizes_and_total(v.seasonlog, "season")


@query("carry_unique", "SELECT id, min(sex) AS sex FROM seasonlog GROUP BY id")
def carry_unique(v):
    return aggregate.carry_unique(v.seasonlog, ["id"], ["sex"])


REPLICATED = f"""day AS (SELECT id, date, season, sex, avg({TB}) AS tb FROM fieldlog GROUP BY id, date, season, sex),
    seen AS (SELECT DISTINCT id, date, hr FROM fieldlog),
    rep AS (SELECT id, date, hr, tb, season, sex FROM day JOIN seen USING (id, date))"""


@query(
    "replicate_unique",
    f"WITH {REPLICATED} SELECT id, D{{date}} AS date, I{{hr}} AS hr, R{{tb}} AS tb, season, sex FROM rep",
)
def replicate_unique(v):
    return aggregate.replicate_unique(with_tb(v.fieldlog))


@query(
    "individual_db",
    f"""SELECT id, D{{date}} AS date, I{{hr}} AS hr, season, sex, R{{avg({DB_SQL})}} AS individual_db,
               R{{avg({TB})}} AS tb FROM seasonlog WHERE sex <> 'ZZf' GROUP BY id, date, hr, season, sex""",
)
def individual_db(v):
    return aggregate.individual_db(joins.band_deviation(with_tb(v.seasonlog), "tb"))


def _de_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT *, 'de_{s}' AS analysis, {deviation_sql('te', *b)} AS de FROM envlog"""
        for s, b in BANDS.items()
    )


@query(
    "habitat_quality",
    f"""SELECT D{{date}} AS date, type, model_id, I{{hr}} AS hr, season, analysis, R{{avg(te)}} AS te,
               R{{avg(de)}} AS de, R{{avg(CASE WHEN de >= 0.5 THEN 0 ELSE 1 END)}} AS ex
        FROM ({_de_rows()}) GROUP BY date, type, model_id, hr, season, analysis""",
)
def habitat_quality(v):
    rows = joins.band_deviation_all(v.envlog, "te").withColumn("ex", X.in_range_flag(F.col("de")))
    return aggregate.habitat_quality(rows)


@query(
    "grand_mean_de",
    f"SELECT analysis, season, R{{avg(de)}} AS de_season FROM ({_de_rows()}) GROUP BY analysis, season",
)
def grand_mean_de(v):
    return aggregate.grand_mean_de(joins.band_deviation_all(v.envlog, "te"))


@query(
    "season_db",
    f"""SELECT id, season, sex, R{{avg({DB_SQL})}} AS db_mean FROM seasonlog WHERE sex <> 'ZZf'
        GROUP BY id, season, sex""",
)
def season_db(v):
    return aggregate.season_db(joins.band_deviation(with_tb(v.seasonlog), "tb"))


@query(
    "hourly_profile",
    f"SELECT I{{hr}} AS hr, season, sex, R{{avg({TB})}} AS tb FROM seasonlog GROUP BY hr, season, sex",
)
def hourly_profile(v):
    return aggregate.hourly_profile(with_tb(v.seasonlog), "tb", ["hr", "season", "sex"])


@query(
    "hourly_profile_habitat",
    "SELECT I{hr} AS hr, season, type, R{avg(te)} AS te FROM envlog GROUP BY hr, season, type",
)
def hourly_profile_habitat(v):
    return aggregate.hourly_profile(v.envlog, "te", ["hr", "season", "type"])


@query(
    "data_range",
    "SELECT R{min(te)} AS min, R{max(te)} AS max, R{max(te) - min(te)} AS range, R{avg(te)} AS mean FROM envlog",
)
def data_range(v):
    return aggregate.data_range(v.envlog, "te")


# ---- arg-max, spread, order, reshape ---------------------------------------


@query(
    "argmax_first",
    """SELECT id, sex, season, I{hr} AS hr, R{ms2} AS ms2, R{tsurf} AS tsurf FROM (
         SELECT *, row_number() OVER (PARTITION BY id, sex, season
                ORDER BY ms2 DESC, tsurf, hr) AS rn
         FROM (SELECT id, sex, season, hr, tsurf, max(ms2) AS ms2 FROM seasonlog
               GROUP BY id, sex, season, hr, tsurf)) WHERE rn = 1""",
)
def argmax_first(v):
    fits = v.seasonlog.groupBy("id", "sex", "season", "hr", "tsurf").agg(F.max("ms2").alias("ms2"))
    return reshape.argmax_first(fits, ["id", "sex", "season"], "ms2", ["tsurf", "hr"])


@query(
    "argmax_ties",
    """SELECT id, season, R{tsurf} AS tsurf, R{ms2} AS ms2 FROM (
         SELECT id, season, tsurf, ms2, max(ms2) OVER (PARTITION BY id, season) AS top FROM seasonlog)
       WHERE ms2 = top""",
)
def argmax_ties(v):
    rows = v.seasonlog.select("id", "season", "tsurf", "ms2")
    return reshape.argmax_ties(rows, ["id", "season"], "ms2")


@query(
    "topt_pmax",
    f"""SELECT id, sex, season, R{{avg({TB})}} AS topt, R{{avg(ms2)}} AS pmax FROM (
         SELECT id, sex, season, tsurf, round(ms2, 9) AS ms2,
                max(round(ms2, 9)) OVER (PARTITION BY id, sex, season) AS top FROM seasonlog)
       WHERE ms2 = top GROUP BY id, sex, season""",
)
def topt_pmax(v):
    return reshape.topt_pmax(with_tb(v.seasonlog), fit="ms2")


_BINS = "bins AS (SELECT sex, tsurf, avg(ms2) AS m FROM seasonlog GROUP BY sex, tsurf)"


@query(
    "group_ci",
    f"""WITH {_BINS} SELECT sex, R{{tsurf}} AS tsurf, R{{m}} AS m,
        R{{stddev_samp(m) OVER (PARTITION BY sex) / sqrt(count(*) OVER (PARTITION BY sex))}} AS se FROM bins""",
)
def group_ci(v):
    bins = v.seasonlog.groupBy("sex", "tsurf").agg(F.avg("ms2").alias("m"))
    return reshape.group_ci(bins, ["sex"], "m", ci=False)


# 0.975 quantile of t with 49 degrees of freedom: one bin per whole l_quantity.
_T49 = 2.0095752371292397


@query(
    "group_ci_limits",
    f"""WITH {_BINS}, spread AS (SELECT sex, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS n
                                  FROM bins GROUP BY sex)
        SELECT sex, R{{tsurf}} AS tsurf, R{{m}} AS m, R{{se}} AS se,
               R{{CASE WHEN n = 50 THEN m - {_T49} * se END}} AS lower_ci,
               R{{CASE WHEN n = 50 THEN m + {_T49} * se END}} AS upper_ci
        FROM bins JOIN spread USING (sex)""",
)
def group_ci_limits(v):
    bins = v.seasonlog.groupBy("sex", "tsurf").agg(F.avg("ms2").alias("m"))
    return reshape.group_ci(bins, ["sex"], "m")


@query("sort_by", "SELECT id, I{hr} AS hr, R{tsurf} AS tsurf FROM seasonlog ORDER BY id, hr, tsurf")
def sort_by(v):
    return clean.sort_by(v.seasonlog.select("id", "hr", "tsurf"), "id", "hr", "tsurf")


@query(
    "union_rows",
    """SELECT season, R{avg(te)} AS mean, 'Te' AS sex FROM envlog GROUP BY season
       UNION ALL SELECT season, R{avg(tsurf)}, sex FROM seasonlog GROUP BY season, sex""",
)
def union_rows(v):
    te = v.envlog.groupBy("season").agg(F.avg("te").alias("mean")).withColumn("sex", F.lit("Te"))
    tb = v.seasonlog.groupBy("season", "sex").agg(F.avg("tsurf").alias("mean"))
    return clean.union_rows(te, tb)


@query(
    "pivot_wide",
    "SELECT season, "
    + ", ".join(
        f"R{{max(CASE WHEN sex = '{s}' THEN {c} END)}} AS {c}_{s}"
        for s in ("ZZf", "ZWf", "ZZm")
        for c in ("mean", "se")
    )
    + """ FROM (SELECT season, sex, avg(tsurf) AS mean, stddev_samp(tsurf) / sqrt(count(*)) AS se
          FROM seasonlog GROUP BY season, sex) GROUP BY season""",
)
def pivot_wide(v):
    table = aggregate.mean_se(v.seasonlog, "tsurf", ["season", "sex"])
    wide = {"mean": "mean", "se": "se"}
    return reshape.pivot_wide(table, ["season"], "sex", ["ZZf", "ZWf", "ZZm"], wide)


@query(
    "five_number_digits",
    "SELECT type, season, "
    + ", ".join(f"R{{{_q('te', p / 100)}}} AS q{p}" for p in (0, 25, 50, 75, 100))
    + " FROM envlog GROUP BY type, season",
)
def five_number_digits(v):
    return selection.five_number_by_digits(v.envlog, "te", ["type", "season"])


@query(
    "tset_digits",
    f"SELECT id, sex, R{{{_q('tsurf', 0.75)} - {_q('tsurf', 0.25)}}} AS iqr FROM seasonlog GROUP BY id, sex",
)
def tset_digits(v):
    return selection.tset_by_digits(v.seasonlog, "tsurf")


@query(
    "residual_digits",
    """WITH fit AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pairs),
       r AS (SELECT y - (i + s * x) AS r FROM pairs, fit)
       SELECT R{quantile_cont(r, 0.0)} AS q0, R{quantile_cont(r, 0.25)} AS q25, R{quantile_cont(r, 0.5)} AS q50,
       R{quantile_cont(r, 0.75)} AS q75, R{quantile_cont(r, 1.0)} AS q100 FROM r""",
)
def residual_digits(v):
    """Residuals are nearly all different: the case in which a range must be cut again and again."""
    line = v.pairs.agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    rows = v.pairs.join(F.broadcast(line)).select((F.col("y") - (F.col("i") + F.col("s") * F.col("x"))).alias("r"))
    return selection.five_number_by_digits(rows, "r")


@query(
    "p95_sketched",
    "SELECT season, sex, I{count(ms2)} AS n, 'true' AS within FROM seasonlog GROUP BY season, sex",
)
def p95_sketched(v):
    """95th percentiles by season and sex, merged from stored sketches of hours; beside the exact ranks."""
    hours = ["id", "sex", "season", "date", "hr"]
    place = scratch_path(v.spark, "sketches")
    write_snapshot(sketches.quantile_sketches(v.seasonlog, hours, "ms2"), place, ["season"])
    kept = v.spark.read.parquet(place)
    keys = ["season", "sex"]
    merged = sketches.sketched_quantiles(sketches.merge_sketches(kept, keys), {"p95": 0.95})
    off = sketches.off_by(v.seasonlog, keys, "ms2", merged, "p95", 0.95)
    within = (F.col("off") <= sketches.rank_error()).alias("within")
    return merged.select(*keys, "n").join(off, keys).select(*keys, "n", within)


@query(
    "tracking_days_bitmap",
    "SELECT id, I{count(DISTINCT date)} AS days FROM fieldlog GROUP BY id",
)
def tracking_days_bitmap(v):
    """Days from stored bitmaps of two halves of the log."""
    place = scratch_path(v.spark, "days")
    half = F.pmod(F.xxhash64("ts"), F.lit(2))
    for k in (0, 1):
        aggregate.day_bitmaps(v.fieldlog.where(half == k)).write.mode("append").parquet(place)
    return aggregate.days_of(aggregate.merge_days(v.spark.read.parquet(place)))


@query(
    "individual_db_bucketed",
    """SELECT id, D{date} AS date, I{hr} AS hr, R{avg(tsurf)} AS tsurf, R{quantile_cont(ms2, 0.95)} AS p95,
       R{max(days.n)} AS readings FROM seasonlog JOIN
       (SELECT id, date, count(*) AS n FROM seasonlog GROUP BY id, date) days USING (id, date) GROUP BY id, date, hr""",
)
def individual_db_bucketed(v):
    """Hourly means and percentiles, and the readings of the day, over a layout bucketed by individual and day."""
    return hourly_on_buckets(bucketed_log(v, "individual_db"))


def bucketed_log(v, name, buckets=16):
    place = scratch_path(v.spark, f"bucketed-{name}")
    table = f"bucketed_{place.rsplit('-', 1)[-1]}"
    rows = v.seasonlog.select("id", "date", "hr", "tsurf", "ms2")
    return write_bucketed(rows, table, place, buckets, ["id", "date"])


def hourly_on_buckets(log):
    hours = quantiles.p95_hourly(log, "ms2", "tsurf", keys=("id", "date", "hr"))
    days = log.groupBy("id", "date").agg(F.count(F.lit(1)).cast("double").alias("readings"))
    return hours.join(days, ["id", "date"]).select("id", "date", "hr", "tsurf", "p95", "readings")
