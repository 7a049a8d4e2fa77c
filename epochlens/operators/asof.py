"""As-of joins, and joins on validity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str, take: list[str], direction: str = "backward", allow_equal: bool = True, max_gap_s: float | None = None) -> DataFrame:
    """Each left row with the nearest right row before (or after) it in the same key; take: the right columns to bring, all of the right row nearest.

    Both sides are laid in one line per key and swept once by a window: no pairs are made. Of right rows with the same instant the one
    with the largest (backward) or smallest (forward) taken values is used. Left rows without a match stay, with nulls.
    """
    forward = direction == "forward"
    rest = [c for c in left.columns if c not in by]
    lhs = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(*rest).alias("_l"), F.lit(None).cast(right.select(F.struct(F.col(right_ts).alias("_at"), *take)).schema[0].dataType).alias("_r"))
    rhs = right.where(F.col(right_ts).isNotNull()).groupBy(*by, F.col(right_ts).alias("_ts")).agg((F.min if forward else F.max)(F.struct(F.col(right_ts).alias("_at"), *take)).alias("_r"))
    rhs = rhs.select(*by, "_ts", F.lit(None).cast(lhs.schema["_l"].dataType).alias("_l"), "_r")
    # right rows come first at equal instants if equal ones may match, else last
    rank = F.when(F.col("_l").isNull(), 0 if allow_equal else 1).otherwise(1 if allow_equal else 0)
    w = W.partitionBy(*by).orderBy(F.col("_ts").desc() if forward else F.col("_ts").asc(), rank).rowsBetween(W.unboundedPreceding, 0)
    found = lhs.unionByName(rhs).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    if max_gap_s is not None:
        gap = F.abs(F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("_m._at").cast("timestamp"))) / 1e6
        found = found.withColumn("_m", F.when(gap <= max_gap_s, F.col("_m")))
    return found.select(*by, "_l.*", F.col("_m._at").alias(f"{right_ts}_matched"), *(F.col(f"_m.{c}").alias(c) for c in take))


def _in_windows(rows: DataFrame, windows: DataFrame, by: list[str], at: str, known_at: str | None, found: list[Column]) -> DataFrame:
    """rows with aggregates over the windows [valid_from, valid_to) that hold their instant; each distinct question is asked once, so that repeated rows stay."""
    asked = [*by, at, *([known_at] if known_at else [])]
    on = (F.col("w.valid_from") <= F.col(f"l.{at}")) & (F.col("w.valid_to").isNull() | (F.col(f"l.{at}") < F.col("w.valid_to")))
    if known_at:
        on &= F.col("w.available_at") <= F.col(f"l.{known_at}")
    for c in by:
        on &= F.col(f"l.{c}") == F.col(f"w.{c}")
    hits = rows.select(*asked).distinct().alias("l").join(windows.alias("w"), on).groupBy(*(F.col(f"l.{c}").alias(f"_{c}") for c in asked)).agg(*found)
    same = F.lit(True)
    for c in asked:
        same &= F.col(c) == F.col(f"_{c}")
    return rows.join(hits, same, "left")


def resolve_identifier(rows: DataFrame, windows: DataFrame, *, by: list[str], at: str, target: str, known_at: str | None = None) -> DataFrame:
    """Each row with the one target whose window [valid_from, valid_to) holds the instant; null unless exactly one distinct target does.

    known_at: a column of rows; windows learned of after it (by their available_at) don't count.
    """
    found = _in_windows(rows, windows, by, at, known_at, [F.min(f"w.{target}").alias("_lo"), F.max(f"w.{target}").alias("_hi")])
    return found.select(*(rows[c] for c in rows.columns), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(target))


def identifier_of(rows: DataFrame, windows: DataFrame, *, by: list[str], at: str, value: str) -> DataFrame:
    """The reverse: null unless exactly one window (not one distinct value) holds the instant."""
    found = _in_windows(rows, windows, by, at, None, [F.count("*").alias("_n"), F.min(f"w.{value}").alias("_v")])
    return found.select(*(rows[c] for c in rows.columns), F.when(F.col("_n") == 1, F.col("_v")).alias(value))


def contained(rows: DataFrame, spans: DataFrame, *, day: Column, at: str, span_day: str, open_ts: str, close_ts: str, take: str) -> DataFrame:
    """The span of the same day that holds the instant: open included, close not; one span a day."""
    s = spans.select(F.col(span_day).alias("_day"), F.col(open_ts).alias("_o"), F.col(close_ts).alias("_c"), F.col(take).alias("_take"))
    joined = rows.withColumn("_key", day).join(s, F.col("_key") == F.col("_day"), "left")
    return joined.select(*rows.columns, F.when((F.col("_o") <= F.col(at)) & (F.col(at) < F.col("_c")), F.col("_take")).alias(take))
