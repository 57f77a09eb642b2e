"""Sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ectolog import functions as X
from ectolog import sources
from ectolog.functions.columns import MODEL_TO_CARCASS, SEASONS, SKIN_TO_BODY
from ectolog.operators import aggregate, clean
from ectolog.session import scratch_path
from ectolog.stats import ols
from ectolog.workload.registry import query
from ectolog.workload.views import season_sql

# ---- sources and sinks -----------------------------------------------------

_PAIR_TEXT = "SELECT id, type, R{a} AS a, R{b} AS b, R{x} AS x FROM pairs"


@query("src_csv", _PAIR_TEXT)
def src_csv(v):
    cols = v.pairs.select("id", "type", "a", "b", "x")
    path = scratch_path(v.spark, "src_csv")
    sources.write_csv(cols, path)
    return sources.read_csv(v.spark, path, cols.schema)


@query(
    "src_csv_text",
    "SELECT CAST(id AS VARCHAR) AS id, type, CAST(CAST(x AS INTEGER) AS VARCHAR) AS x FROM pairs",
)
def src_csv_text(v):
    path = scratch_path(v.spark, "src_csv_text")
    sources.write_csv(v.pairs.select("id", "type", F.col("x").cast("int").alias("x")), path)
    return sources.read_csv_text(v.spark, path, ["id", "type", "x"])


@query(
    "src_snapshot",
    """SELECT l_orderkey, I{l_linenumber} AS l_linenumber, R{l_quantity} AS l_quantity,
              T{l_shipdate} AS l_shipdate FROM lineitem""",
)
def src_snapshot(v):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]
    return sources.read_snapshot(v.spark, f"{v.sf_dir}/lineitem.parquet", cols)


@query(
    "sink_snapshot",
    """SELECT id, D{date} AS date, I{hr} AS hr, R{avg(tsurf)} AS tsurf, season
       FROM seasonlog GROUP BY id, date, hr, season""",
)
def sink_snapshot(v):
    stage = v.seasonlog.groupBy("id", "date", "hr", "season").agg(F.avg("tsurf").alias("tsurf"))
    path = scratch_path(v.spark, "sink_snapshot")
    sources.write_snapshot(stage, path, partition_by=["season"])
    return sources.read_snapshot(v.spark, path)


@query(
    "sink_csv",
    "SELECT season, sex, I{count(*)} AS n, R{avg(tsurf)} AS mean FROM seasonlog GROUP BY season, sex",
)
def sink_csv(v):
    table = v.seasonlog.groupBy("season", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.avg("tsurf").alias("mean")
    )
    path = scratch_path(v.spark, "sink_csv")
    sources.write_csv(table, path)
    return sources.read_csv(v.spark, path, table.schema)


@query(
    "csv_quarantine",
    """SELECT 'rows' AS what, type, I{count(*)} AS n, R{avg(x)} AS x FROM pairs WHERE x <> 7 GROUP BY type
       UNION ALL SELECT 'refused', type, I{count(*)}, CAST(NULL AS DOUBLE) FROM pairs WHERE x = 7 GROUP BY type""",
)
def csv_quarantine(v):
    """Lines with a cell that is no number are set apart; the others are all there."""
    cells = v.pairs.select("id", "type", F.when(F.col("x") == 7, "n/a").otherwise(F.col("x").cast("string")).alias("x"))
    path = scratch_path(v.spark, "csv_quarantine")
    sources.write_csv(cells, path)
    found = sources.read_csv_checked(v.spark, path, "id long, type string, x double")
    rows = found.rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    refused = found.refused.select(F.split("line", ",")[1].alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    parts = [t.withColumn("what", F.lit(w)) for t, w in ((rows, "rows"), (refused.withColumn("x", F.lit(None).cast("double")), "refused"))]
    return parts[0].unionByName(parts[1]).select("what", "type", "n", "x")


@query(
    "snapshot_replace",
    """SELECT season, sex, I{count(*)} AS n, R{CASE WHEN season = 'Winter' THEN avg(tsurf) + 1 ELSE avg(tsurf) END} AS tsurf
       FROM seasonlog GROUP BY season, sex""",
)
def snapshot_replace(v):
    """One season is written again with other values; the other seasons stay."""
    path = scratch_path(v.spark, "snapshot_replace")
    stage = v.seasonlog.select("season", "sex", "tsurf")
    sources.replace_partitions(stage, path, ["season"])
    again = stage.where("season = 'Winter'").withColumn("tsurf", F.col("tsurf") + 1)
    sources.replace_partitions(again, path, ["season"])
    kept = v.spark.read.parquet(path)
    return kept.groupBy("season", "sex").agg(F.count(F.lit(1)).alias("n"), F.avg("tsurf").alias("tsurf"))


_HISTORY = """
    SELECT CASE WHEN survived THEN '10' ELSE '11' END
           || chr(9) || CAST(CASE WHEN sex = 'ZZm' THEN 1 ELSE 0 END AS VARCHAR)
           || chr(9) || CAST(CASE WHEN sex = 'ZWf' THEN 1 ELSE 0 END AS VARCHAR)
           || chr(9) || regexp_replace(printf('%.3f', {trait}), '\\.?0+$', '') || ';' AS value
    FROM survlog"""


def _round3_sql(x: str) -> str:
    low, high = f"(floor({x} * 1000.0) / 1000.0)", f"(ceil({x} * 1000.0) / 1000.0)"
    tie = f"CASE WHEN floor({x} * 1000.0) % 2 = 0 THEN {low} ELSE {high} END"
    return (
        f"CASE WHEN {x} - {low} < {high} - {x} THEN {low} "
        f"WHEN {high} - {x} < {x} - {low} THEN {high} ELSE {tie} END"
    )


@query("sink_history", _HISTORY.format(trait=_round3_sql("trait")))
def sink_history(v):
    dummies = [
        F.when(F.col("sex") == s, 1).otherwise(0).cast("string") for s in ("ZZm", "ZWf")
    ]
    row = sources.history_rows(F.col("survived"), dummies, [F.col("trait")])
    path = scratch_path(v.spark, "sink_history")
    sources.write_history(v.survlog, row, path)
    return v.spark.read.text(path)


@query(
    "model_table_io",
    """SELECT type, I{regr_count(y, x)} AS n, R{regr_slope(y, x)} AS slope,
              R{regr_intercept(y, x)} AS intercept FROM pairs GROUP BY type""",
)
def model_table_io(v):
    fit = ols.fit_ols(v.pairs, "y", "x", by=["type"]).select("type", "n", "slope", "intercept")
    path = scratch_path(v.spark, "model")
    sources.save_model({"coefficients": fit}, path)
    return sources.load_model(v.spark, path, ["coefficients"])["coefficients"]


# ---- projections and filters ----------------------------------------------


@query("project_cols", "SELECT season, sex, id, R{tsurf} AS tsurf FROM seasonlog")
def project_cols(v):
    return clean.project_cols(v.seasonlog, ["season", "sex", "id", "tsurf"])


@query("drop_cols", "SELECT id, sex, D{date} AS date, I{hr} AS hr, season FROM seasonlog")
def drop_cols(v):
    gone = ["tsurf", "ms2", "x_ms2", "y_ms2", "acc", "month"]
    return clean.drop_cols(v.seasonlog, gone)


@query(
    "rename_cols",
    "SELECT id AS lizard, type AS habitat, R{x} AS tsurf_temp, R{y} AS tsel_temp FROM pairs",
)
def rename_cols(v):
    df = v.pairs.select("id", "type", "x", "y")
    by_position = clean.rename_cols(df, {0: "lizard", 1: "habitat"})
    return clean.rename_cols(by_position, {"x": "tsurf_temp", "y": "tsel_temp"})


@query(
    "derive_cols",
    f"""SELECT id, R{{tsurf}} AS tsurf, R{{{SKIN_TO_BODY[0]} + tsurf * {SKIN_TO_BODY[1]}}} AS tb,
               R{{sqrt(x_ms2 + y_ms2)}} AS vect FROM seasonlog""",
)
def derive_cols(v):
    return clean.derive_cols(
        v.seasonlog.select("id", "tsurf", "x_ms2", "y_ms2"),
        {
            "tb": X.calibrate_linear(F.col("tsurf"), *SKIN_TO_BODY),
            "vect": X.movement_vector(F.col("x_ms2"), F.col("y_ms2")),
        },
    ).drop("x_ms2", "y_ms2")


@query(
    "filter_hours",
    "SELECT id, D{date} AS date, I{hr} AS hr, R{tsurf} AS tsurf FROM fieldlog WHERE hr >= 5 AND hr <= 21",
)
def filter_hours(v):
    return clean.filter_hours(v.fieldlog).select("id", "date", "hr", "tsurf")


@query(
    "filter_dates",
    """SELECT id, D{date} AS date, R{tsurf} AS tsurf FROM seasonlog
       WHERE date >= DATE '1996-03-01' AND date <= DATE '2000-10-31' AND date < DATE '1999-09-01'""",
)
def filter_dates(v):
    return clean.filter_dates(
        v.seasonlog.select("id", "date", "tsurf"),
        start="1996-03-01",
        until="2000-10-31",
        before="1999/09/01",
    )


@query(
    "filter_category",
    "SELECT id, sex, season, R{tsurf} AS tsurf FROM seasonlog WHERE sex <> 'ZZf' AND season = 'Spring'",
)
def filter_category(v):
    kept = clean.filter_category(v.seasonlog, "sex", drop=["ZZf"])
    spring = clean.filter_category(kept, "season", keep=["Spring"])
    return spring.select("id", "sex", "season", "tsurf")


@query("filter_band", "SELECT model_id, R{te} AS te FROM envlog WHERE te >= -4 AND te <= 49")
def filter_band(v):
    return clean.filter_band(v.envlog.select("model_id", "te"), "te")


_HOLES = "CASE WHEN x = 13 THEN NULL ELSE x END"


@query(
    "drop_missing",
    f"SELECT id, R{{x}} AS x FROM (SELECT id, {_HOLES} AS x FROM pairs) WHERE x IS NOT NULL",
)
def drop_missing(v):
    holes = v.pairs.select("id", F.when(F.col("x") != 13, F.col("x")).alias("x"))
    return clean.drop_missing(holes)


@query("distinct_rows", "SELECT DISTINCT id, I{hr} AS hr, season FROM seasonlog")
def distinct_rows(v):
    return clean.distinct_rows(v.seasonlog.select("id", "hr", "season"))


@query("distinct_values", "SELECT DISTINCT id FROM seasonlog")
def distinct_values(v):
    return clean.distinct_values(v.seasonlog, "id")


# ---- scalar functions ------------------------------------------------------


@query(
    "parse_ts",
    """SELECT event_id, T{date_trunc('minute', ts)} AS dmy_hm, T{date_trunc('second', ts)} AS ymd_hms,
              D{ts} AS dmy FROM events""",
)
def parse_ts(v):
    text = v.table("events").select(
        "event_id",
        F.date_format("ts", "d/MM/yy HH:mm").alias("a"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("b"),
        F.date_format("ts", "d/MM/yyyy").alias("c"),
    )
    return text.select(
        "event_id",
        X.parse_ts(F.col("a")).alias("dmy_hm"),
        X.parse_ts(F.col("b"), "yyyy-MM-dd HH:mm:ss").alias("ymd_hms"),
        X.parse_date(F.col("c")).alias("dmy"),
    )


@query("hour_of", "SELECT event_id, I{hour(ts)} AS hr FROM events")
def hour_of(v):
    return v.table("events").select("event_id", X.hour_of(F.col("ts")).alias("hr"))


@query("date_of", "SELECT event_id, D{ts} AS date FROM events")
def date_of(v):
    return v.table("events").select("event_id", X.date_of(F.col("ts")).alias("date"))


@query("month_name", "SELECT o_orderkey, monthname(o_orderdate) AS month FROM orders")
def month_name(v):
    return v.table("orders").select("o_orderkey", X.month_name(F.col("o_orderdate")).alias("month"))


@query("season_of", f"SELECT o_orderkey, {season_sql('o_orderdate')} AS season FROM orders")
def season_of(v):
    return v.table("orders").select("o_orderkey", X.season_of(F.col("o_orderdate")).alias("season"))


@query(
    "calibrate_linear",
    f"""SELECT id, R{{{SKIN_TO_BODY[0]} + tsurf * {SKIN_TO_BODY[1]}}} AS tb,
               R{{{MODEL_TO_CARCASS[0]} + tsurf * {MODEL_TO_CARCASS[1]}}} AS te FROM seasonlog""",
)
def calibrate_linear(v):
    x = F.col("tsurf")
    return v.seasonlog.select(
        "id",
        X.calibrate_linear(x, *SKIN_TO_BODY).alias("tb"),
        X.calibrate_linear(x, *MODEL_TO_CARCASS).alias("te"),
    )


@query(
    "round_half_even",
    f"""SELECT o_orderkey, R{{round_even(o_totalprice / 2.0, 0)}} AS whole,
               R{{{_round3_sql('(o_totalprice / 1000000.0)')}}} AS third FROM orders""",
)
def round_half_even(v):
    price = F.col("o_totalprice")
    return v.table("orders").select(
        "o_orderkey",
        X.round_half_even(price / 2.0).alias("whole"),
        X.round_half_even(price / 1000000.0, 3).alias("third"),
    )


@query(
    "signif",
    """SELECT o_orderkey, R{round_even(o_totalprice * pow(10.0, 1.0 - floor(log10(o_totalprice))), 0)
              / pow(10.0, 1.0 - floor(log10(o_totalprice)))} AS price2 FROM orders""",
)
def signif(v):
    return v.table("orders").select("o_orderkey", X.signif(F.col("o_totalprice"), 2).alias("price2"))


@query(
    "movement_vector",
    """SELECT id, R{CASE WHEN x_ms2 + y_ms2 >= 0 THEN sqrt(x_ms2 + y_ms2) END} AS vect,
              R{sqrt(x_ms2 * x_ms2 + y_ms2 * y_ms2)} AS length FROM fieldlog""",
)
def movement_vector(v):
    x, y = F.col("x_ms2"), F.col("y_ms2")
    vect = X.movement_vector(x, y)
    return v.fieldlog.select(
        "id",
        F.when(~F.isnan(vect), vect).alias("vect"),
        X.movement_vector(x, y, kind="euclid").alias("length"),
    )


def deviation_sql(x: str, lo: float, hi: float, origin: float | None = None) -> str:
    return (
        f"CASE WHEN {x} < {lo} THEN {lo if origin is None else origin} - {x} "
        f"WHEN {x} > {hi} THEN {x} - {hi} WHEN {x} IS NOT NULL THEN 0.0 END"
    )


@query(
    "setpoint_deviation",
    f"""SELECT id, R{{tsurf}} AS tsurf, R{{{deviation_sql('tsurf', 25.33, 32.03)}}} AS dev,
               R{{{deviation_sql('tsurf', 25.33, 32.03, 26.97309)}}} AS dev_published FROM seasonlog""",
)
def setpoint_deviation(v):
    x = F.col("tsurf")
    return v.seasonlog.select(
        "id",
        x,
        X.setpoint_deviation(x, 25.33, 32.03).alias("dev"),
        X.setpoint_deviation(x, 25.33, 32.03, lo_origin=26.97309).alias("dev_published"),
    )


@query(
    "in_range_flag",
    f"""SELECT id, R{{tsurf}} AS tsurf,
               I{{CASE WHEN {deviation_sql('tsurf', 25.5, 32.0)} >= 0.5 THEN 0 ELSE 1 END}} AS ex
        FROM seasonlog""",
)
def in_range_flag(v):
    dev = X.setpoint_deviation(F.col("tsurf"), 25.5, 32.0)
    return v.seasonlog.select("id", "tsurf", X.in_range_flag(dev).alias("ex"))


@query(
    "active_flag",
    "SELECT id, R{acc} AS acc, I{CASE WHEN acc <= 0 THEN 0 WHEN acc > 0 THEN 1 END} AS active FROM fieldlog",
)
def active_flag(v):
    return v.fieldlog.select("id", "acc", X.active_flag(F.col("acc")).alias("active"))


@query(
    "iqr_bounds",
    """SELECT id, R{m} AS mean_tb, R{i} AS iqr, R{i / 2} AS half_range, R{m + i / 2} AS upper,
              R{m - i / 2} AS lower
       FROM (SELECT id, avg(tsurf) AS m, max(tsurf) - min(tsurf) AS i FROM seasonlog GROUP BY id)""",
)
def iqr_bounds(v):
    from ectolog.operators.quantiles import iqr_bounds as bounds

    spread = (F.max("tsurf") - F.min("tsurf")).alias("iqr")
    return bounds(v.seasonlog.groupBy("id").agg(F.avg("tsurf").alias("mean_tb"), spread))


@query(
    "effectiveness_index",
    """SELECT id, R{CASE WHEN de <> 0 THEN 1 - db / de END} AS e_index
       FROM (SELECT id, avg(ms2) AS db, avg(tsurf) - 1 AS de FROM seasonlog GROUP BY id, date)""",
)
def effectiveness_index(v):
    daily = v.seasonlog.groupBy("id", "date").agg(
        F.avg("ms2").alias("db"), (F.avg("tsurf") - 1).alias("de")
    )
    return daily.select("id", X.effectiveness_index(F.col("db"), F.col("de")).alias("e_index"))


@query("log1p", "SELECT id, R{ln(1.0 + x)} AS log_x FROM pairs")
def log1p(v):
    return v.pairs.select("id", F.log1p("x").alias("log_x"))


@query("clamp_min", "SELECT model_id, R{CASE WHEN te < 0 THEN 0.0 ELSE te END} AS te FROM envlog")
def clamp_min(v):
    return v.envlog.select("model_id", X.clamp_min(F.col("te")).alias("te"))


@query("rescale", "SELECT id, R{trait * 100.0} AS up, R{trait * 0.01} AS down FROM survlog")
def rescale(v):
    x = F.col("trait")
    return v.survlog.select("id", X.rescale(x, 100.0).alias("up"), X.rescale(x, 0.01).alias("down"))


@query(
    "relabel",
    "SELECT id, replace(replace('de_' || sex, 'ZZm', 'Male'), 'ZWf', 'Female') AS label FROM seasonlog",
)
def relabel(v):
    code = F.concat(F.lit("de_"), F.col("sex"))
    return v.seasonlog.select("id", X.relabel(code, {"ZZm": "Male", "ZWf": "Female"}).alias("label"))


@query(
    "level_order",
    """SELECT season, I{CASE season WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 WHEN 'Autumn' THEN 3
              WHEN 'Winter' THEN 4 END} AS season_rank, I{count(*)} AS n FROM seasonlog GROUP BY season""",
)
def level_order(v):
    rank = X.level_rank(F.col("season"), SEASONS)
    counts = aggregate.sample_sizes(v.seasonlog, ["season"]).withColumn("season_rank", rank)
    return clean.sort_by(counts, "season_rank")


@query(
    "cast_cols",
    """SELECT CAST(id AS VARCHAR) AS id, CAST(hr AS VARCHAR) AS hr, I{CAST(tsurf AS INTEGER)} AS tsurf
       FROM seasonlog""",
)
def cast_cols(v):
    df = v.seasonlog.select("id", "hr", "tsurf")
    return clean.cast_cols(df, {"id": "string", "hr": "string", "tsurf": "int"})


@query(
    "p_label",
    "SELECT id, CASE WHEN a < 0.01 THEN '<0.01' ELSE printf('%.3f', a) END AS p FROM pairs",
)
def p_label(v):
    return v.pairs.select("id", X.p_label(F.col("a")).alias("p"))


@query(
    "mean_se_text",
    """SELECT id, printf('%.2f (%.2f)', avg(tsurf), stddev_samp(tsurf) / sqrt(count(tsurf))) AS cell
       FROM seasonlog GROUP BY id""",
)
def mean_se_text(v):
    table = aggregate.mean_se(v.seasonlog, "tsurf", ["id"])
    return table.select("id", X.mean_se_text(F.col("mean"), F.col("se")).alias("cell"))


@query(
    "error_band",
    """SELECT id, R{m} AS mean, R{m - s} AS lower, R{m + s} AS upper
       FROM (SELECT id, avg(tsurf) AS m, stddev_samp(tsurf) / sqrt(count(tsurf)) AS s
             FROM seasonlog GROUP BY id)""",
)
def error_band(v):
    table = aggregate.mean_se(v.seasonlog, "tsurf", ["id"])
    return table.select("id", "mean", *X.error_band(F.col("mean"), F.col("se")))
