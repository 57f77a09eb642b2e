"""The engine's tables bound to the test tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.functions import month_name, season_of
from ectolog.functions.columns import SEASON_MONTHS

# Movement reading that stands for each kind of event.
ACCELERATION = {"click": 1.5, "purchase": 3.0, "signup": 0.25, "view": 0.0, "error": -0.5}
SEX_OF = {0: "ZWf", 1: "ZZm", 2: "ZZf"}


def _case(col, mapping):
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out


class Views:
    """Lazy bindings; a query scans only the columns it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fieldlog(self) -> DataFrame:
        return field_log(self.table("events"))

    @cached_property
    def seasonlog(self) -> DataFrame:
        date = F.to_date("l_shipdate")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("id"),
            _case(F.col("l_suppkey") % 3, SEX_OF).alias("sex"),
            date.alias("date"),
            (F.col("l_partkey") % 17 + 5).cast("int").alias("hr"),
            month_name(date).alias("month"),
            season_of(date).alias("season"),
            F.col("l_quantity").alias("tsurf"),
            (F.col("l_discount") + F.col("l_tax")).alias("ms2"),
            F.col("l_discount").alias("x_ms2"),
            F.col("l_tax").alias("y_ms2"),
            (F.col("l_discount") - F.col("l_tax")).alias("acc"),
        )

    @cached_property
    def envlog(self) -> DataFrame:
        date = F.to_date("l_shipdate")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("model_id"),
            F.concat("l_returnflag", "l_linestatus").alias("type"),
            date.alias("date"),
            (F.col("l_partkey") % 17 + 5).cast("int").alias("hr"),
            season_of(date).alias("season"),
            (F.col("l_quantity") * 1.4 - 5.0).alias("te"),
        )

    @cached_property
    def survlog(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            _case(F.col("o_custkey") % 3, SEX_OF).alias("sex"),
            (F.col("o_orderstatus") == "F").alias("survived"),
            F.col("o_orderpriority").alias("grp"),
            (F.col("o_totalprice") / 1000000.0).alias("trait"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("id"),
            F.concat("l_returnflag", "l_linestatus").alias("type"),
            F.col("l_tax").alias("a"),
            F.col("l_discount").alias("b"),
            F.col("l_quantity").alias("x"),
            (F.col("l_extendedprice") / 1000.0).alias("y"),
        )


def field_log(events: DataFrame) -> DataFrame:
    """The 2-minute log, from a batch or a stream of events."""
    date = F.to_date("ts")
    return events.select(
        F.col("ts"),
        F.col("user_id").alias("id"),
        _case(F.col("user_id") % 3, SEX_OF).alias("sex"),
        date.alias("date"),
        F.hour("ts").alias("hr"),
        month_name(date).alias("month"),
        season_of(date).alias("season"),
        (F.col("value") % 50.0).alias("tsurf"),
        (F.col("value") / 100.0).alias("x_ms2"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("y_ms2"),
        _case(F.col("event_type"), ACCELERATION).alias("acc"),
    )


# ---- the same bindings as SQL ----------------------------------------------


def season_sql(date: str) -> str:
    arms = " ".join(
        f"WHEN month({date}) IN ({', '.join(map(str, m))}) THEN '{s}'"
        for s, m in SEASON_MONTHS.items()
    )
    return f"CASE {arms} END"


def _sex_sql(expr: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in SEX_OF.items())
    return f"CASE {expr} {arms} END"


_ACC = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in ACCELERATION.items())

VIEW_SQL = {
    "fieldlog": f"""
        SELECT ts, user_id AS id, {_sex_sql('user_id % 3')} AS sex, CAST(ts AS DATE) AS date,
               CAST(hour(ts) AS INTEGER) AS hr, monthname(ts) AS month,
               {season_sql('ts')} AS season, value % 50.0 AS tsurf, value / 100.0 AS x_ms2,
               CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) / 100.0 AS y_ms2,
               CASE event_type {_ACC} END AS acc
        FROM events""",
    "seasonlog": f"""
        SELECT l_suppkey AS id, {_sex_sql('l_suppkey % 3')} AS sex,
               CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 17 + 5 AS INTEGER) AS hr,
               monthname(l_shipdate) AS month, {season_sql('l_shipdate')} AS season,
               l_quantity AS tsurf, l_discount + l_tax AS ms2,
               l_discount AS x_ms2, l_tax AS y_ms2, l_discount - l_tax AS acc
        FROM lineitem""",
    "envlog": f"""
        SELECT l_suppkey AS model_id, l_returnflag || l_linestatus AS type,
               CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 17 + 5 AS INTEGER) AS hr,
               {season_sql('l_shipdate')} AS season, l_quantity * CAST(1.4 AS DOUBLE) - 5.0 AS te
        FROM lineitem""",
    "survlog": f"""
        SELECT o_orderkey AS id, {_sex_sql('o_custkey % 3')} AS sex,
               o_orderstatus = 'F' AS survived, o_orderpriority AS grp,
               o_totalprice / 1000000.0 AS trait
        FROM orders""",
    "pairs": """
        SELECT l_suppkey AS id, l_returnflag || l_linestatus AS type, l_tax AS a,
               l_discount AS b, l_quantity AS x, l_extendedprice / 1000.0 AS y
        FROM lineitem""",
}
