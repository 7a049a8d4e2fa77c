"""How much is there: coverage, work queues and health as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_coverage(rows: DataFrame, key: str, linked: str) -> DataFrame:
    """Per key how many rows, how many of them linked, and whether all are."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count(linked).alias("linked")).withColumn("resolved", F.col("total") == F.col("linked"))


def worst(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The k worst offenders; a report's limit."""
    return rows.orderBy(*by).limit(k)


def membership(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """rows with ``listed``: whether the key is among the known ones; a null key is in no set."""
    marks = known.select(F.col(known_key).alias(key)).distinct().withColumn("_m", F.lit(True))
    return rows.join(marks, key, "left").withColumn("listed", F.coalesce("_m", F.lit(False))).drop("_m")


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, known, total and share, a row for each field."""
    counted = rows.agg(F.count("*").alias("total"), *(F.count(c).alias(c) for c in fields))
    return counted.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("known")) for c in fields))).alias("x")).select("x.field", "x.known", "total", (F.col("x.known") / F.col("total")).alias("share"))


def window_coverage(windows: DataFrame, counts: DataFrame, *, sessions: str, keys: list[str], bars: str, least: int) -> DataFrame:
    """windows with ``covered``: every session of an event has at least so many bars of each of its instruments.

    windows has an event id, an array of sessions and one instrument column for each of keys; counts has instrument, day and bars.
    """
    wanted = windows.select("event_id", F.explode(sessions).alias("day"), F.array(*keys).alias("_k")).select("event_id", "day", F.explode("_k").alias("instrument"))
    met = wanted.join(counts, ["instrument", "day"], "left").groupBy("event_id").agg(F.bool_and(F.coalesce(F.col(bars), F.lit(0)) >= least).alias("covered"))
    return windows.join(met, "event_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def months_needed(windows: DataFrame, *, sessions: str, instrument: str, index: str) -> DataFrame:
    """Distinct (instrument, month) that the windows touch, for their own instrument and the index."""
    months = windows.select(instrument, F.explode(sessions).alias("_d")).select(F.explode(F.array(F.col(instrument), F.lit(index))).alias("instrument"), F.trunc("_d", "month").alias("month"))
    return months.distinct()


def stale_links(filings: DataFrame, links: DataFrame, securities: DataFrame, build: int) -> DataFrame:
    """Filings to link again: those never linked, those left unresolved under an older build, and those linked to a security that has been merged away."""
    merged = securities.where("merged_into is not null").select("security_id", F.lit(True).alias("_gone"))
    state = filings.join(links, "filing_id", "left").join(merged, "security_id", "left")
    again = F.col("build").isNull() | (F.col("security_id").isNull() & (F.col("build") < build)) | F.coalesce("_gone", F.lit(False))
    return state.where(again).select(*filings.columns)


def due_days(sources: DataFrame, first: Column, last: Column, loaded: DataFrame, settled: DataFrame) -> DataFrame:
    """(source, day) from first to last that are neither loaded nor settled."""
    asked = sources.select("source", F.explode(F.sequence(first, last)).alias("day"))
    return asked.join(loaded.select("source", "day"), ["source", "day"], "left_anti").join(settled.select("source", "day"), ["source", "day"], "left_anti")


def health(rules: list[tuple[str, str, Column]], facts: DataFrame) -> DataFrame:
    """facts: one row. code, level and severity of the rules that hold, to be put in order of severity: an error before a warning before a note."""
    rank = {"error": 0, "warning": 1, "note": 2}
    found = facts.select(F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(rank[level]).alias("severity"), F.coalesce(holds, F.lit(False)).alias("holds")) for code, level, holds in rules))).alias("x"))
    return found.select("x.*").where("holds").drop("holds")


#: Rows that one task flattens: of a larger table there are more tasks, not larger ones.
ROWS_A_TASK = 250_000


def flattened(rows: DataFrame, keys: list[str], name: str, values: list[str], exits: list[str]) -> DataFrame:
    """One row for each key with a column for each value and exit: ret_d0, ret_d1, … ; of several values of one exit the smallest. Most keys have few rows, so that rows are dealt out as they are."""
    parts = -(-rows.count() // ROWS_A_TASK)
    dealt = rows.repartition(parts, *keys) if parts > 1 else rows
    return dealt.groupBy(*keys).agg(*(F.min(F.when(F.col(name) == x, F.col(v))).alias(f"{v}_{x}") for v in values for x in exits))


def overnight_split(days: DataFrame, by: list[str], *, opens: str, close: str, previous: str, weight: str) -> DataFrame:
    """Per group the mean overnight, intraday and whole return, each stock alike and by weight; days without a previous close say nothing."""
    known = days.where((F.col(previous) > 0) & (F.col(opens) > 0))
    night, day, whole = F.try_divide(opens, previous) - 1, F.try_divide(close, opens) - 1, F.try_divide(close, previous) - 1
    weighed = lambda x: F.try_divide(F.sum(x * F.col(weight)), F.sum(weight))
    return known.groupBy(*by).agg(F.count("*").alias("n"), *(f(x).alias(f"{n}_{k}") for n, x in (("overnight", night), ("intraday", day), ("whole", whole)) for k, f in (("equal", F.avg), ("weighted", weighed))))
