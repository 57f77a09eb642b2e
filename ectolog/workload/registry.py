"""Registry of queries and the common form both engines give their results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ectolog.workload.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Averages can fall exactly half-way between two shown values, where the order
# of summation would decide. Both engines shift by this before rounding.
NUDGE = 1.37e-8
DIGITS = 6


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, integers as long, dates and times as text."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col + F.lit(NUDGE), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(f.dataType, (T.DateType, T.BooleanType)):
            col = col.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(f.name))
    return df.select(*out)


def sql_text(body: str, digits: int = DIGITS) -> str:
    """Expand the marks of an oracle and put the views it names in front.

    ``R{..}`` rounded double, ``I{..}`` long, ``D{..}`` date text,
    ``T{..}`` timestamp text.
    """
    body = re.sub(
        r"\bR\{([^{}]*)\}", rf"round(CAST((\1) AS DOUBLE) + {NUDGE!r}, {digits}) + 0.0", body
    )
    body = re.sub(r"\bI\{([^{}]*)\}", r"CAST((\1) AS BIGINT)", body)
    body = re.sub(r"\bD\{([^{}]*)\}", r"CAST(CAST((\1) AS DATE) AS VARCHAR)", body)
    body = re.sub(r"\bT\{([^{}]*)\}", r"strftime((\1), '%Y-%m-%d %H:%M:%S')", body)
    used = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", body)]
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in used)
    body = body.strip()
    if not used:
        return body
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(views) -> DataFrame`` with its equivalent SQL, if it has one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Views(spark, sf_dir)), digits)

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_text(sql, digits)
        return fn

    return add
