"""Queries: point-in-time reads, mutations, calendar, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions.scalars import available_at, effective_availability, exchange_date, r6
from epochlens.operators import asof, merge, pit
from epochlens.operators import calendar as cal_ops
from epochlens.plans.registry import CALENDAR_SQL, micros, query, table


def events_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(exchange_date(F.col("ts")).alias("day"))
    return cal_ops.calendar(days, days.limit(0))


@query("SELECT event_id, user_id, epoch_us(ts) AS known_us FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00'")
def pit_since(spark, d):
    rows = pit.known_between(table(spark, d, "events"), "ts", F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-10 12:00:00").cast("timestamp"))
    return rows.select("event_id", "user_id", micros("ts").alias("known_us"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, epoch_us(max(ts)) AS known_us FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def pit_latest_per_key(spark, d):
    known = table(spark, d, "events").where("ts <= timestamp '2024-01-15 00:00:00'").select("user_id", "event_id", "ts")
    return pit.latest_per_key(known, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", micros("ts").alias("known_us"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def pit_snapshot_latest(spark, d):
    return pit.newest_snapshot(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_custkey")


@query("""
SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE)::VARCHAR AS day, epoch_us(min(ts)) AS first_us, count(*) AS members
FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL HAVING min(ts) > TIMESTAMP '2024-01-10 00:00:00'""")
def event_groups_having(spark, d):
    e = table(spark, d, "events").withColumn("day", exchange_date(F.col("ts")))
    g = pit.event_groups(e, ["user_id", "day"], "ts", "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return g.select("user_id", F.col("day").cast("string").alias("day"), micros("first_known").alias("first_us"), "members")


@query("""
WITH m AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'backfill' ELSE 'live' END AS mode, ts + to_seconds(event_id % 120 - 30) AS fetched, date_trunc('minute', ts) AS whole FROM events),
a AS (SELECT *, CASE WHEN mode = 'backfill' THEN ts ELSE greatest(fetched, ts) END AS avail FROM m)
SELECT event_id, mode, epoch_us(avail) AS available_us, epoch_us(greatest(avail, whole + INTERVAL 60 SECOND)) AS effective_us FROM a""")
def ingest_mode_availability(spark, d):
    e = table(spark, d, "events").withColumn("mode", F.when(F.col("event_id") % 3 == 0, "backfill").otherwise("live"))
    fetched = F.timestamp_micros(micros("ts") + (F.col("event_id") % 120 - 30) * 1_000_000)
    e = e.withColumn("avail", available_at(F.col("mode"), F.col("ts"), fetched)).withColumn("whole", F.date_trunc("minute", "ts"))
    eff = effective_availability(F.col("avail"), F.col("whole"), F.lit(None).cast("timestamp"))
    return e.select("event_id", "mode", micros("avail").alias("available_us"), F.unix_micros(eff).alias("effective_us"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def keep_first(spark, d):
    return merge.keep_first(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def _halves(spark, d):
    day = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    first = merge.keep_first(day.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])
    return first, merge.keep_first(day.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


_HALVES = """
a AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"""


@query(f"WITH {_HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def insert_ignore(spark, d):
    a, b = _halves(spark, d)
    return merge.insert_ignore(a, b, ["user_id", "event_type"], ["event_id"])


@query(f"WITH {_HALVES} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.event_id, b.event_id) AS event_id, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert_first_seen(spark, d):
    a, b = _halves(spark, d)
    return merge.upsert(a, b, ["user_id", "event_type"], ["value"])


@query(f"""WITH {_HALVES}
SELECT a.user_id, a.event_type, a.event_id, CASE WHEN a.event_id % 4 = 0 AND b.user_id IS NOT NULL THEN b.value ELSE a.value END AS value, a.event_id % 4 AS raw FROM a LEFT JOIN b USING (user_id, event_type)
UNION ALL SELECT b.user_id, b.event_type, b.event_id, b.value, 0 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)""")
def reparse_same_payload(spark, d):
    a, b = _halves(spark, d)
    return merge.reparse(a.withColumn("raw", F.col("event_id") % 4), b.withColumn("raw", F.lit(0).cast("long")), ["user_id", "event_type"], "raw", ["value", "event_id"], ["event_id"])


@query("""
WITH s AS (
  SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 50 <> 1
  UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 100 = 3
), v AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS valid_from FROM customer)
SELECT c_custkey, a AS c_mktsegment, f::VARCHAR AS valid_from, t::VARCHAR AS valid_to FROM (
  SELECT v.c_custkey, v.c_mktsegment AS a, v.valid_from AS f, CASE WHEN s.c_custkey IS NULL OR s.c_mktsegment <> v.c_mktsegment THEN DATE '2024-02-01' END AS t
  FROM v LEFT JOIN s USING (c_custkey) WHERE s.c_custkey IS NULL OR s.c_mktsegment = v.c_mktsegment OR v.valid_from < DATE '2024-02-01'
  UNION ALL
  SELECT s.c_custkey, s.c_mktsegment, DATE '2024-02-01', NULL FROM s LEFT JOIN v USING (c_custkey) WHERE v.c_custkey IS NULL OR s.c_mktsegment <> v.c_mktsegment)""")
def scd2_apply(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    early, late = F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date")
    versions = c.withColumn("valid_from", F.when(F.col("c_custkey") % 20 == 0, late).otherwise(early)).withColumn("valid_to", F.lit(None).cast("date"))
    snap = c.where("c_custkey % 50 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    snap = snap.unionByName(c.where("c_custkey % 100 = 3").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    out = merge.scd2_apply(versions, snap, keys=["c_custkey"], attrs=["c_mktsegment"], as_of=late)
    return out.select("c_custkey", "c_mktsegment", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query("SELECT user_id, count(*) AS attempts, arg_max(event_type, (ts, event_id)) AS last_status, CASE WHEN bool_or(event_type = 'purchase') THEN 'complete' WHEN count(*) >= 50 THEN 'gave_up' ELSE 'incomplete' END AS status FROM events GROUP BY 1")
def attempts_status(spark, d):
    log = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type")).alias("status"))
    out = merge.attempts(log, ["user_id"], "at", "status", 50)
    return out.withColumn("last_status", F.when(F.col("last_status") == "complete", "purchase").otherwise(F.col("last_status")))


@query(f"WITH {CALENDAR_SQL} SELECT day::VARCHAR AS day, is_session, is_special, session_no, epoch_us(open_ts) AS open_us, epoch_us(close_ts) AS close_us FROM cal")
def calendar_sessions(spark, d):
    return events_calendar(spark, d).select(F.col("day").cast("string"), "is_session", "is_special", "session_no", micros("open_ts").alias("open_us"), micros("close_ts").alias("close_us"))


@query(f"WITH {CALENDAR_SQL} SELECT a.day::VARCHAR AS day, b.day::VARCHAR AS shifted FROM cal a LEFT JOIN cal b ON b.session_no = a.session_no + 3")
def session_shift(spark, d):
    cal = events_calendar(spark, d)
    return cal_ops.shift_session(cal.select("day"), cal, "day", 3, "shifted").select(F.col("day").cast("string"), F.col("shifted").cast("string"))


@query(f"WITH {CALENDAR_SQL} SELECT e.event_id, o.day::VARCHAR AS entry_day FROM events e ASOF LEFT JOIN (SELECT day, open_ts FROM cal WHERE session_no IS NOT NULL) o ON e.ts < o.open_ts")
def next_session_open(spark, d):
    return cal_ops.next_open(table(spark, d, "events").select("event_id", "ts"), events_calendar(spark, d), "ts").select("event_id", F.col("entry_day").cast("string"))


@query(f"WITH {CALENDAR_SQL} SELECT e.event_id, CASE WHEN c.open_ts <= e.ts AND e.ts < c.close_ts THEN c.session_no END AS session_no FROM events e LEFT JOIN cal c ON c.day = CAST(e.ts + INTERVAL 330 MINUTE AS DATE)")
def session_of(spark, d):
    out = asof.contained(table(spark, d, "events").select("event_id", "ts"), events_calendar(spark, d), day=exchange_date(F.col("ts")), at="ts", span_day="day", open_ts="open_ts", close_ts="close_ts", take="session_no")
    return out.select("event_id", "session_no")


def _ticks(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'signup'").select("event_id", (F.col("user_id") % 16).alias("k"), "ts")
    right = e.where("event_type = 'purchase'").select((F.col("user_id") % 16).alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("hit"))
    return left, right


_TICKS = "l AS (SELECT event_id, user_id % 16 AS k, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id % 16 AS k, ts AS at, event_id AS hit FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_TICKS} SELECT l.event_id, r.hit FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.at")
def asof_backward(spark, d):
    left, right = _ticks(spark, d)
    return asof.asof_join(left, right, by=["k"], left_ts="ts", right_ts="at", take=["hit"]).select("event_id", "hit")


@query(f"WITH {_TICKS} SELECT l.event_id, CASE WHEN epoch_us(r.at) - epoch_us(l.ts) <= 3600000000 THEN r.hit END AS hit FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts <= r.at")
def asof_forward_inclusive(spark, d):
    left, right = _ticks(spark, d)
    return asof.asof_join(left, right, by=["k"], left_ts="ts", right_ts="at", take=["hit"], direction="forward", max_gap_s=3600).select("event_id", "hit")


@query(f"WITH {_TICKS} SELECT l.event_id, r.hit FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts < r.at")
def asof_forward_strict(spark, d):
    left, right = _ticks(spark, d)
    return asof.asof_join(left, right, by=["k"], left_ts="ts", right_ts="at", take=["hit"], direction="forward", allow_equal=False).select("event_id", "hit")


def _order_windows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("valid_from"), (F.col("o_custkey") % 97).alias("target"), "o_orderkey")
    return merge.windows_of_changes(o.groupBy("o_custkey", "valid_from").agg(F.min("o_orderkey").alias("target")), ["o_custkey"], "valid_from")


_WINDOWS = "g AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderkey) AS target FROM orders GROUP BY ALL), w AS (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to FROM g)"


@query(f"WITH {_WINDOWS} SELECT o.o_orderkey, w.target FROM orders o LEFT JOIN w ON w.o_custkey = o.o_custkey AND w.valid_from <= CAST(o.o_orderdate AS DATE) + 30 AND (w.valid_to IS NULL OR CAST(o.o_orderdate AS DATE) + 30 < w.valid_to)")
def identifier_range_join(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_add(F.to_date("o_orderdate"), 30).alias("at"))
    return asof.resolve_identifier(rows, _order_windows(spark, d), by=["o_custkey"], at="at", target="target").select("o_orderkey", "target")


@query("""
WITH w AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 60 AS valid_to, o_orderstatus AS value FROM orders),
r AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) + 10 AS on_day FROM orders),
j AS (SELECT r.o_custkey, r.on_day, count(w.valid_from) AS n, min(value) AS lo, max(value) AS hi FROM r LEFT JOIN w ON w.o_custkey = r.o_custkey AND w.valid_from <= r.on_day AND r.on_day < w.valid_to GROUP BY ALL)
SELECT o_custkey, on_day::VARCHAR AS on_day, CASE WHEN lo = hi THEN lo END AS resolved, CASE WHEN n = 1 THEN lo END AS only_window FROM j""")
def ambiguous_is_null(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    w = o.select("o_custkey", day.alias("valid_from"), F.date_add(day, 60).alias("valid_to"), F.col("o_orderstatus").alias("value"))
    rows = o.select("o_custkey", F.date_add(day, 10).alias("on_day")).distinct()
    a = asof.resolve_identifier(rows, w, by=["o_custkey"], at="on_day", target="value").withColumnRenamed("value", "resolved")
    b = asof.identifier_of(rows, w, by=["o_custkey"], at="on_day", value="value").withColumnRenamed("value", "only_window")
    return a.join(b, ["o_custkey", "on_day"]).select("o_custkey", F.col("on_day").cast("string"), "resolved", "only_window")


@query("""
WITH f AS (SELECT o_custkey, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS period_end, o_orderkey % 3 = 0 AS consolidated, sum(o_totalprice) AS revenue FROM orders GROUP BY ALL),
e AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS on_day FROM orders WHERE o_orderstatus = 'P'),
k AS (SELECT e.on_day, f.*, row_number() OVER (PARTITION BY e.o_custkey, e.on_day, consolidated ORDER BY period_end DESC) AS n FROM e JOIN f ON e.o_custkey = f.o_custkey AND period_end + 30 <= e.on_day),
s AS (SELECT o_custkey, on_day, consolidated, sum(revenue) AS total FROM k WHERE n <= 4 GROUP BY ALL
  HAVING count(*) = 4 AND date_diff('month', min(period_end), max(period_end)) = 9 AND date_diff('day', max(period_end), on_day) <= 280)
SELECT e.o_custkey, e.on_day::VARCHAR AS on_day, floor(coalesce(max(total) FILTER (consolidated), max(total) FILTER (NOT consolidated)) * 100 + 0.5) / 100 AS trailing_revenue FROM e LEFT JOIN s ON s.o_custkey = e.o_custkey AND s.on_day = e.on_day GROUP BY ALL""")
def trailing_four_quarters(spark, d):
    o = table(spark, d, "orders")
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    filings = o.groupBy("o_custkey", end.alias("period_end"), (F.col("o_orderkey") % 3 == 0).alias("consolidated")).agg(F.sum("o_totalprice").alias("revenue")).withColumn("available_at", F.date_add("period_end", 30))
    events = o.where("o_orderstatus = 'P'").select("o_custkey", F.to_date("o_orderdate").alias("on_day"))
    out = pit.trailing_four(events, filings, "o_custkey", "on_day")
    return out.select("o_custkey", F.col("on_day").cast("string"), (F.floor(F.col("trailing_revenue") * 100 + 0.5) / 100).alias("trailing_revenue"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o WHERE o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F')")
def not_exists_prefer(spark, d):
    return merge.prefer(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_queue(spark, d):
    return merge.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], F.col("quality") == 1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_refs(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
WITH v AS (SELECT user_id AS entity, event_type AS flag, CAST(min(ts) AS DATE) AS valid_from, CAST(max(ts) AS DATE) AS valid_to FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND event_type IN ('error', 'signup') GROUP BY ALL),
e AS (SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS day FROM events)
SELECT e.entity, e.day::VARCHAR AS day, CASE WHEN e.day >= (SELECT min(valid_from) FROM v) THEN coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (valid_from <= e.day AND e.day < valid_to), '') END AS flags
FROM e LEFT JOIN v ON v.entity = e.entity GROUP BY e.entity, e.day""")
def restrictions_on(spark, d):
    e = table(spark, d, "events")
    v = e.where("ts >= timestamp '2024-01-05 00:00:00' and event_type in ('error', 'signup')").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("flag")).agg(F.to_date(F.min("ts")).alias("valid_from"), F.to_date(F.max("ts")).alias("valid_to"))
    days = e.select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day")).distinct()
    out = pit.flags_on(v, days, "entity", "day", "flag")
    return out.select("entity", F.col("day").cast("string"), F.array_join("flags", ",").alias("flags"))
