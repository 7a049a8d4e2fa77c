"""Streams over landing folders, written batch by batch with foreachBatch.

Every batch owns its own folders of its target, overwritten if the batch is tried again; what the others hold is read from theirs. So a batch that fails half-way, or
that Spark runs twice, leaves the same rows. A target is cut by day, and a batch reads the days of its own rows only, however long the history is: a key's rows all have one
event time. What goes on from batch to batch (an instrument's last instant, filings that still wait) is a small table of its own, one folder a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.operators.merge import keep_first

BATCH, DAY = "batch", "_day"


def landing(spark: SparkSession, folder: str, schema: T.StructType, *, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of the files that come into a folder, oldest first, so many a batch (all that have come, if not said)."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    system, p = _files(spark, path)
    return system.exists(p)


def _folders(spark: SparkSession, path: str) -> list[str]:
    system, p = _files(spark, path)
    return [x.getPath().getName() for x in system.listStatus(p)] if system.exists(p) else []


def read_target(spark: SparkSession, target: str, schema: T.StructType, days: list[str] | None = None) -> DataFrame:
    """Rows with their batch's number: all, or those of some days, whose folders alone are listed."""
    whole = T.StructType([*(f for f in schema.fields if f.name not in (BATCH, DAY)), T.StructField(DAY, T.StringType()), T.StructField(BATCH, T.LongType())])
    found = [target] if days is None else [f"{target}/{DAY}={x}" for x in days]
    found = [x for x in found if _exists(spark, x)]
    read = spark.read.schema(whole).option("basePath", target).parquet(*found) if found else spark.createDataFrame([], whole)
    return read.drop(DAY)


def wider(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """A schema with further fields, where it doesn't have them."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more.items() if n not in schema.names)])


def _day(ts: str | None) -> Column:
    """The folder of a row: its day in UTC; one folder for all if rows have no event time."""
    return F.coalesce(F.to_date(ts).cast("string"), F.lit("none")) if ts else F.lit("all")


def _days(batch: DataFrame, ts: str | None) -> list[str]:
    return sorted(r[0] for r in batch.select(_day(ts)).distinct().collect())  # as many as a batch has days


def _write(rows: DataFrame, target: str, number: int, ts: str | None) -> None:
    """The rows as the batch's own folder of each day; a batch that is tried again has the same days."""
    rows.drop(BATCH).withColumn(DAY, _day(ts)).withColumn(BATCH, F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(target)


def _carried(spark: SparkSession, folder: str, number: int, schema: T.StructType) -> DataFrame:
    """The small table that the batch before has left."""
    before = [n for n in (int(x.split("=")[1]) for x in _folders(spark, folder) if x.startswith(f"{BATCH}=")) if n < number]
    return spark.read.schema(schema).parquet(f"{folder}/{BATCH}={max(before)}") if before else spark.createDataFrame([], schema)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], parts: int | None = None) -> None:
    """Everything that has come so far, then stop; a later run goes on from the checkpoint. parts: into how many parts a new checkpoint cuts the stream's state (the session's shuffle partitions, if not said)."""
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    if parts:
        conf.set(name, str(parts))
    try:
        started = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # has a copy of the settings from here on
    finally:
        conf.set(name, before)
    started.awaitTermination()


def ingest(stream: DataFrame, target: str, checkpoint: str, *, keys: list[str], order: list[str], ts: str | None = None) -> None:
    """Rows with new natural keys are added, the first write of a key wins, and rows polled again change nothing. The first batch is ``catchup``, later ones ``live``."""
    spark, schema = stream.sparkSession, stream.schema

    def each(batch: DataFrame, number: int) -> None:
        known = read_target(spark, target, wider(schema, mode=T.StringType()), _days(batch, ts)).where(F.col(BATCH) != number)
        fresh = keep_first(batch, keys, order).join(known.select(*keys), keys, "left_anti")
        _write(fresh.withColumn("mode", F.lit("catchup" if number == 0 else "live")), target, number, ts)

    run(stream, checkpoint, each)


def reconcile(target: str, collected: DataFrame, *, keys: list[str], order: list[str], ts: str, now: Column, days: int = 7) -> int:
    """What a second collection of the last days has and the stream hadn't, labelled ``backfill``; late rows are never dropped for being late.

    Every call has a number of its own, counted down from -1 in a folder beside the target, so that it meets neither the stream's batches nor an earlier call; one that fails half-way is simply made again. Gives the number.
    """
    spark = collected.sparkSession
    schema = wider(collected.schema, mode=T.StringType())
    recent = keep_first(collected.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days))), keys, order)
    number = -1 - len(_folders(spark, f"{target}-calls"))
    system, p = _files(spark, f"{target}-calls/{-number}")
    system.mkdirs(p)
    known = read_target(spark, target, schema, _days(recent, ts))
    _write(recent.join(known.select(*keys), keys, "left_anti").withColumn("mode", F.lit("backfill")), target, number, ts)
    return number


def newer_bars(stream: DataFrame, target: str, checkpoint: str, *, key: str, ts: str, order: list[str]) -> None:
    """Bars of each instrument that are newer than the last one it has; one for each instant. Each instrument's last instant goes on from batch to batch."""
    spark = stream.sparkSession
    carried = T.StructType([stream.schema[key], T.StructField("_last", stream.schema[ts].dataType)])

    def each(batch: DataFrame, number: int) -> None:
        last = _carried(spark, f"{target}-last", number, carried)
        fresh = keep_first(batch, [key, ts], order).join(last, key, "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
        _write(fresh, target, number, ts)
        now = last.unionByName(batch.select(key, F.col(ts).alias("_last"))).groupBy(key).agg(F.max("_last").alias("_last"))
        now.write.mode("overwrite").parquet(f"{target}-last/{BATCH}={number}")

    run(stream, checkpoint, each)


def hand_off(stream: DataFrame, target: str, checkpoint: str, *, key: str, classify: Column, link: Callable[[DataFrame, int], DataFrame], most: int = 3, ts: str | None = None) -> None:
    """New rows are classified and linked in the batch that brings them; those that no link is known for yet come along in later batches, ``most`` times in all.

    link(rows, batch) adds security_id. target holds a row for each try: event_type, security_id, tries. Rows that still wait go on from batch to batch.
    """
    spark = stream.sparkSession
    schema = wider(stream.schema, security_id=T.LongType(), event_type=T.StringType(), tries=T.IntegerType())

    def each(batch: DataFrame, number: int) -> None:
        again = _carried(spark, f"{target}-waiting", number, schema).drop("security_id")
        known = read_target(spark, target, schema, _days(batch, ts)).where(F.col(BATCH) != number).select(key)
        new = batch.join(known, key, "left_anti").dropDuplicates([key]).withColumn("event_type", classify).withColumn("tries", F.lit(0))
        linked = link(new.select(*again.columns).unionByName(again), number)
        _write(linked.withColumn("tries", F.col("tries") + 1).select(*schema.names), target, number, ts)
        own = [x for x in (f"{target}/{day}/{BATCH}={number}" for day in _folders(spark, target)) if _exists(spark, x)]
        tried = spark.read.schema(schema).option("basePath", target).parquet(*own) if own else spark.createDataFrame([], schema)
        tried.where(F.col("security_id").isNull() & (F.col("tries") < most)).select(*schema.names).write.mode("overwrite").parquet(f"{target}-waiting/{BATCH}={number}")

    run(stream, checkpoint, each)


def minute_bars(stream: DataFrame, *, key: str, ts: str, value: str, order: str, margin: str = "3 seconds") -> DataFrame:
    """Bars of a minute, given out when the minute has ended and its margin is over."""
    at = F.struct(ts, order)
    bars = stream.withWatermark(ts, margin).groupBy(key, F.window(ts, "1 minute").alias("w")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("ticks"))
    return bars.select(key, F.col("w.start").alias("minute"), "open", "high", "low", "close", "ticks")


def append_to(stream: DataFrame, target: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def handed_over(filings: DataFrame, facts: DataFrame, key: str, known: str, facts_at: str, wait_s: int = 900) -> DataFrame:
    """When each filing goes on: with its facts as soon as it has them, or without after ``wait_s`` seconds; one without a security is dropped then."""
    due = F.col(known) + F.make_dt_interval(secs=F.lit(wait_s))
    joined = filings.join(facts, key, "left")
    with_facts = F.col(facts_at).isNotNull() & (F.col(facts_at) <= due)
    return joined.withColumn("handed_at", F.when(with_facts, F.greatest(F.col(facts_at), F.col(known))).otherwise(due)).withColumn("outcome", F.when(F.col("security_id").isNull(), "dropped").when(with_facts, "with_facts").otherwise("without_facts"))
