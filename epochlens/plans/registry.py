"""Queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def micros(c: str):
    return F.unix_micros(F.col(c))


#: SQL of the calendar over the events' days: day, is_session, is_special, session_no, open_ts.
CALENDAR_SQL = """
have AS (SELECT DISTINCT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM events),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM have), (SELECT max(day) FROM have), INTERVAL 1 DAY)) AS DATE) AS day),
flags AS (SELECT d.day, h.day IS NOT NULL OR isodow(d.day) <= 5 AS is_session, h.day IS NOT NULL AND isodow(d.day) > 5 AS is_special FROM days d LEFT JOIN have h ON d.day = h.day),
cal AS (
  SELECT day, is_session, is_special,
    CASE WHEN is_session AND NOT is_special THEN CAST(sum(CASE WHEN is_session AND NOT is_special THEN 1 ELSE 0 END) OVER (ORDER BY day) AS INTEGER) END AS session_no,
    CASE WHEN is_session THEN CAST(day AS TIMESTAMP) + INTERVAL 225 MINUTE END AS open_ts,
    CASE WHEN is_session THEN CAST(day AS TIMESTAMP) + INTERVAL 600 MINUTE END AS close_ts
  FROM flags
)"""
