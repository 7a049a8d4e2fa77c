"""Point-in-time reads: everything that a query sees was known at its clock's instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class AsOf:
    """A clock that never goes back, through which tables are read."""

    def __init__(self, as_of: datetime, known_at: str = "available_at"):
        if as_of.tzinfo is None:
            raise ValueError("the clock needs an instant with an offset")
        self.as_of, self.known_at = as_of, known_at

    def advance(self, to: datetime) -> None:
        if to < self.as_of:
            raise ValueError("the clock never goes back")
        self.as_of = to

    def read(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.known_at) <= F.lit(self.as_of))

    def since(self, rows: DataFrame, since: datetime) -> DataFrame:
        """Rows that became known after ``since``."""
        return known_between(rows, self.known_at, F.lit(since), F.lit(self.as_of))

    def latest(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return latest_per_key(self.read(rows), keys, [self.known_at])


def known_between(rows: DataFrame, known_at: str, since: Column, until: Column) -> DataFrame:
    """Rows known in (since, until]."""
    return rows.where((F.col(known_at) > since) & (F.col(known_at) <= until))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last; found by aggregation, so that no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return found.select(*keys, "_r.*").select(*rows.columns)


def newest_snapshot(rows: DataFrame, day: str) -> DataFrame:
    """All rows of the newest snapshot day."""
    newest = rows.agg(F.max(day).alias("_d"))
    return rows.join(F.broadcast(newest), rows[day] == newest["_d"], "left_semi")  # one row


def event_groups(rows: DataFrame, keys: list[str], event_ts: str, known_at: str, since: Column, until: Column) -> DataFrame:
    """Merged events first known in (since, until]; members that were not known by then are left out before grouping."""
    known = rows.where(F.col(known_at) <= until)
    groups = known.groupBy(*keys).agg(F.min(event_ts).alias("event_ts"), F.min(known_at).alias("first_known"), F.count("*").alias("members"))
    return groups.where(F.col("first_known") > since)


def in_force(rows: DataFrame, day: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Versions valid on a day: [start, end), an open end is null."""
    return rows.where((F.col(start) <= day) & (F.col(end).isNull() | (day < F.col(end))))


def flags_on(versions: DataFrame, entities: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """For each (entity, day) the sorted flags in force; null (unknown, not clear) before the first recorded day."""
    first = versions.agg(F.min("valid_from").alias("_first"))
    held = entities.join(versions, entity, "left").withColumn("_in", (F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to"))))
    found = held.groupBy(entity, day).agg(F.sort_array(F.collect_set(F.when(F.col("_in"), F.col(flag)))).alias("flags"))
    return found.crossJoin(F.broadcast(first)).select(entity, day, F.when(F.col(day) >= F.col("_first"), F.col("flags")).alias("flags"))  # one row


def trailing_four(events: DataFrame, filings: DataFrame, key: str, at: str, max_age_days: int = 280) -> DataFrame:
    """For each event the sum of the four newest quarters known at its instant, or null.

    filings: key, period_end (date), consolidated, revenue, available_at. Of each quarter the newest filing counts; all four must be three
    months apart and the newest not older than max_age_days; consolidated figures are preferred to standalone ones.
    """
    ev = events.select(key, at).distinct()
    known = ev.join(filings, key).where(F.col("available_at") <= F.col(at))
    quarter = known.groupBy(key, at, "consolidated", "period_end").agg(F.max_by("revenue", F.struct("available_at", "revenue")).alias("revenue"))
    w = W.partitionBy(key, at, "consolidated").orderBy(F.desc("period_end"))
    four = quarter.withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("period_end").over(w)).where("n <= 4")
    apart = F.bool_and(F.when(F.col("n") < 4, F.months_between(F.trunc("period_end", "MM"), F.trunc("before", "MM")) == 3).otherwise(True))
    sums = four.groupBy(key, at, "consolidated").agg(F.count("*").alias("n"), apart.alias("apart"), F.max("period_end").alias("newest"), F.sum("revenue").alias("total"))
    good = sums.where((F.col("n") == 4) & F.col("apart") & (F.datediff(F.to_date(at), "newest") <= max_age_days))
    best = good.groupBy(key, at).agg(F.max_by("total", F.col("consolidated").cast("int")).alias("trailing_revenue"))
    return ev.join(best, [key, at], "left")
