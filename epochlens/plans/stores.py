"""Queries: stores that are cut by month, and polls as a data source."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from epochlens.plans.registry import micros, query, table
from epochlens.session import work_path
from epochlens.sources import bars, polled, tables
from epochlens.streaming import ingest


@query("""
WITH b AS (SELECT 'EQ|' || user_id AS instrument_key, date_trunc('hour', ts) AS ts, min(value) AS open, max(value) AS high, min(value) AS low, max(value) AS close, count(*) AS volume, event_id % 2 AS later FROM events GROUP BY user_id, date_trunc('hour', ts), event_id % 2)
SELECT instrument_key, epoch_us(ts) AS ts_us, arg_max(open, later) AS open, arg_max(close, later) AS close, arg_max(volume, later)::BIGINT AS volume FROM b
WHERE ts >= TIMESTAMP '2024-01-09 04:00:00' AND ts < TIMESTAMP '2024-01-20 07:30:00' GROUP BY instrument_key, ts""")
def month_store(spark, d):
    """Bars come in two loads, of which the second one holds newer bars for some instants, and once more, which changes nothing; then a range is read."""
    e = table(spark, d, "events")
    folder = work_path(spark, "bars")
    for k in (0, 1, 1):
        load = e.where(F.col("event_id") % 2 == k).groupBy(F.concat(F.lit("EQ|"), "user_id").alias("instrument_key"), F.date_trunc("hour", "ts").alias("ts"))
        bars.merge_months(load.agg(F.min("value").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max("value").alias("close"), F.count("*").alias("volume")), folder)
    found = bars.read_bars(spark, folder, datetime(2024, 1, 9, 4, tzinfo=timezone.utc), datetime(2024, 1, 20, 7, 30, tzinfo=timezone.utc))
    return found.select("instrument_key", micros("ts").alias("ts_us"), "open", "close", "volume")


@query("""
SELECT sha256(html) AS doc_id, min(page_id % 3)::BIGINT AS poll, strlen(html)::BIGINT AS bytes, NULL AS error FROM pages WHERE html IS NOT NULL GROUP BY html
UNION ALL SELECT sha256(html), 3, NULL, 'digest' FROM pages WHERE html IS NOT NULL AND page_id % 7 = 0 GROUP BY html""")
def stream_polled_store(spark, d):
    """Three polls, read by a stream that is stopped and started again between them, and a fourth whose files were damaged afterwards: its payloads go to quarantine."""
    polled.register(spark)
    pages = table(spark, d, "pages").where("html is not null").select("page_id", F.col("html").cast("binary").alias("content"), F.lit("page").alias("kind"), F.timestamp_seconds("page_id").alias("fetched_at"))
    folder, target, checkpoint = (work_path(spark, x) for x in ("polls", "target", "checkpoint"))
    follow = lambda: ingest.append_to(spark.readStream.format(polled.NAME).load(folder), target, checkpoint)
    for k in range(3):
        polled.publish(pages.where(F.col("page_id") % 3 <= k).drop("page_id"), folder)
        if k != 1:
            follow()
    damaged = pages.where("page_id % 7 = 0").select(F.sha2("content", 256).alias("doc_id"), F.concat("content", F.lit(b"x")).alias("content"), "kind", "fetched_at").dropDuplicates(["doc_id"])
    polled._commit(damaged, folder)
    follow()
    return spark.read.parquet(target).select("doc_id", "poll", F.octet_length("content").cast("long").alias("bytes"), "error")


@query("""
SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN 0.0 ELSE 0.0 END AS balance, CASE WHEN c_custkey % 3 = 2 THEN 'seen' ELSE 'none' END AS status, CASE c_custkey % 3 WHEN 2 THEN 'x' ELSE upper(c_name) END AS label FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, c_name, c_acctbal, 'none', 'own' FROM customer WHERE c_custkey % 3 = 0""")
def schema_versions(spark, d):
    """Rows written by three versions of a table's schema, read in the newest one's shape."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    first = {"k": "bigint", "name": "string"}
    second = {"balance": ("double", "0.0"), "status": ("string", "'none'")}
    third = {"label": ("string", "CASE WHEN status = 'none' THEN upper(name) ELSE 'x' END")}
    folder = work_path(spark, "versions")
    rows = c.select(k.alias("k"), F.col("c_name").alias("name"))
    tables.save(rows.where("k % 3 = 1"), folder, tables.Table("customers", first))
    tables.save(rows.where("k % 3 = 2").withColumns({"balance": F.lit(0.0), "status": F.lit("seen")}), folder, tables.Table("customers", first, [second]))
    newest = tables.Table("customers", first, [second, third])
    tables.save(c.where(k % 3 == 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("none").alias("status"), F.lit("own").alias("label")), folder, newest)
    return tables.load(spark, folder, newest)
