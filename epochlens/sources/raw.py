"""A store of payloads by their content: each is written once, under its SHA-256."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, content binary, kind string, fetched_at timestamp, shelf string"


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, content, kind, fetched_at; contents that don't have their id's digest any more raise when they are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(folder)
    intact = F.when(F.sha2("content", 256) == F.col("doc_id"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("doc_id"))))
    return rows.withColumn("content", intact)


def put(payloads: DataFrame, folder: str) -> None:
    """Adds payloads (content, kind, fetched_at) that the store doesn't have; the first of equal ones counts. Putting the same again changes nothing."""
    spark = payloads.sparkSession
    new = payloads.withColumn("doc_id", F.sha2("content", 256)).groupBy("doc_id").agg(F.min_by(F.struct("content", "kind", "fetched_at"), F.struct("fetched_at", "kind")).alias("p"))
    known = read_store(spark, folder).select("doc_id")
    fresh = new.join(known, "doc_id", "left_anti").select("doc_id", "p.*", F.substring("doc_id", 1, 2).alias("shelf"))
    fresh.write.mode("append").partitionBy("shelf").parquet(folder)


def replay(store: DataFrame, kind: str, parse) -> DataFrame:
    """Today's parser over all stored payloads of a kind: parse takes (doc_id, payload)."""
    return parse(store.where(F.col("kind") == kind).select("doc_id", F.col("content").cast("string").alias("payload")))
