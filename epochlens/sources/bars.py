"""A store of minute bars, cut by month and by instrument, of which loads rewrite and reads open the touched parts only."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.operators.merge import newer_wins
from epochlens.session import materialised

#: The store's columns, and into how many parts a month's instruments are dealt.
SCHEMA = "instrument_key string, ts timestamp, open double, high double, low double, close double, volume long, month string, part int"
PARTS = 16
#: Months are those of exchange time.
ZONE = timedelta(hours=5, minutes=30)


def month_of(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "yyyy-MM")


def part_of(instrument: Column) -> Column:
    return F.pmod(F.crc32(instrument), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = T._parse_datatype_string(SCHEMA)
    return spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def months(start: datetime, end: datetime) -> list[str]:
    """The months of exchange time that [start, end) meets."""
    if end <= start:
        return []
    first, last = (x.astimezone(timezone.utc) + ZONE for x in (start, end - timedelta(microseconds=1)))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def merge_months(bars: DataFrame, folder: str, *, only: list[str] | None = None) -> None:
    """Adds bars (instrument_key, ts, open, high, low, close, volume); of equal instants the new bar counts, of equal new ones the least. A load made again changes nothing.

    Only parts of months that the bars touch are read and put in place of what stood there, each as a whole; others aren't opened. only: the months that the load may touch; a bar of another raises before anything is written.
    """
    spark = bars.sparkSession
    values = ["open", "high", "low", "close", "volume"]
    new = bars.where("instrument_key is not null and ts is not null").groupBy("instrument_key", "ts").agg(F.min(F.struct(*values)).alias("b")).select("instrument_key", "ts", "b.*")
    new = new.withColumn("month", month_of(F.col("ts"))).withColumn("part", part_of(F.col("instrument_key")))
    if only is not None:
        guard = F.raise_error(F.concat(F.lit("a bar of "), F.col("month"), F.lit(" in a load of "), F.lit(", ".join(only))))
        new = new.withColumn("month", F.when(F.col("month").isin(only), F.col("month")).otherwise(guard.cast("string")))
    new = materialised(new, "new-bars")
    touched = [(r["month"], r["part"]) for r in new.select("month", "part").distinct().collect()]  # PARTS a month at most
    if not touched:
        return
    by_month: dict[str, list[int]] = {}
    for month, part in touched:
        by_month.setdefault(month, []).append(part)
    reached = F.lit(False)
    for month, parts in sorted(by_month.items()):
        reached |= (F.col("month") == month) & F.col("part").isin(sorted(parts))
    old = _stored(spark, folder).where(reached)
    merged = materialised(newer_wins(old.select(*new.columns), new, ["instrument_key", "ts"]), "merged-bars")
    dealt = merged.repartition("month", "part").sortWithinPartitions("month", "part", "instrument_key", "ts")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "part").parquet(folder)


def read_bars(spark: SparkSession, folder: str, start: datetime, end: datetime, instruments: list[str] | None = None) -> DataFrame:
    """Bars with start <= ts < end, of some instruments or all: the range becomes a list of months, instruments their parts, so that only those folders are opened."""
    import zlib

    found = _stored(spark, folder).where(F.col("month").isin(months(start, end)) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    if instruments is not None:
        found = found.where(F.col("part").isin(sorted({zlib.crc32(x.encode()) % PARTS for x in instruments})) & F.col("instrument_key").isin(instruments))
    return found.drop("month", "part")
