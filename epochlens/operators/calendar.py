"""The trading calendar as a dense dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.functions.scalars import exchange_date, exchange_instant

#: Regular trading hours in exchange time.
OPEN, CLOSE = "09:15", "15:30"


def calendar(loaded: DataFrame, holidays: DataFrame, day: str = "day", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """day, is_session, is_special, session_no, open_ts, close_ts for every day.

    Evidence in order: a loaded file makes a session, a holiday or weekend none, any other day one. A session on a weekend or holiday is
    special: it has no number, and entry rules skip it.
    """
    have = loaded.select(F.col(day).cast("date").alias("day")).distinct().withColumn("_loaded", F.lit(True))
    off = holidays.select(F.col(day).cast("date").alias("day")).distinct().withColumn("_off", F.lit(True))
    span = have.agg(F.coalesce(first, F.min("day")).alias("a") if first is not None else F.min("day").alias("a"), (last if last is not None else F.max("day")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    found = days.join(have, "day", "left").join(off, "day", "left")
    closed = F.coalesce(F.col("_off"), F.lit(False)) | (F.dayofweek("day").isin(1, 7))
    session = F.coalesce(F.col("_loaded"), F.lit(False)) | ~closed
    flagged = found.select("day", session.alias("is_session"), (session & closed).alias("is_special"))
    regular = (F.col("is_session") & ~F.col("is_special")).cast("int")
    # a calendar has some thousands of days; one window numbers them
    numbered = flagged.withColumn("_n", F.sum(regular).over(W.partitionBy(F.lit(0)).orderBy("day")))
    return numbered.select("day", "is_session", "is_special", F.when(regular == 1, F.col("_n")).cast("int").alias("session_no"), F.when(F.col("is_session"), exchange_instant(F.col("day"), OPEN)).alias("open_ts"), F.when(F.col("is_session"), exchange_instant(F.col("day"), CLOSE)).alias("close_ts"))


def shift_session(rows: DataFrame, cal: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """The n-th regular session after (before) a session day; null where there is none."""
    c = cal.where("session_no is not null").select("day", "session_no")
    a, b = c.select(F.col("day").alias("_d"), F.col("session_no").alias("_n")), c.select(F.col("day").alias(out), (F.col("session_no") - n).alias("_n"))
    return rows.join(a, F.col(day) == F.col("_d"), "left").join(b, "_n", "left").select(*rows.columns, out)


def next_open(rows: DataFrame, cal: DataFrame, at: str, out: str = "entry_day") -> DataFrame:
    """The first regular session that opens strictly after the instant: by the instant's exchange day, an equality join on the small calendar."""
    regular = F.when(F.col("session_no").isNotNull(), F.struct("day", "open_ts"))
    order = W.partitionBy(F.lit(0)).orderBy("day")
    ahead = cal.select("day", regular.alias("_own"), F.first(regular, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    joined = rows.withColumn("_day", exchange_date(F.col(at).cast("timestamp"))).join(ahead.withColumnRenamed("day", "_day"), "_day", "left")
    return joined.select(*rows.columns, F.when(F.col("_own.open_ts") > F.col(at).cast("timestamp"), F.col("_own.day")).otherwise(F.col("_next.day")).alias(out))
