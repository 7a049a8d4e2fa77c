"""Queries: streams over landing folders made of the test tables, run until all that has come is read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.operators import identity
from epochlens.plans.registry import micros, query, table
from epochlens.session import work_path
from epochlens.streaming import ingest, stateful


def _polls(spark, d, conditions, step):
    """What each condition on events selects comes into a folder, in as many files as it has parts; then step takes the stream on."""
    folder = work_path(spark, "landing")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for condition in conditions:
        e.where(condition).write.mode("append").parquet(folder)
        step(ingest.landing(spark, folder, e.schema))
    return e


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'catchup' ELSE 'live' END AS mode, event_id % 3 AS batch FROM events")
def stream_exactly_once(spark, d):
    """Each poll brings all that the one before had, and more; every row stands in the table once, as it first came."""
    target, checkpoint = work_path(spark, "target"), work_path(spark, "checkpoint")
    e = _polls(spark, d, ["event_id % 3 = 0", "event_id % 3 < 2", "true"], lambda stream: ingest.ingest(stream, target, checkpoint, keys=["event_id"], order=["ts"], ts="ts"))
    return ingest.read_target(spark, target, ingest.wider(e.schema, mode=T.StringType())).select("event_id", "mode", "batch")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'catchup' WHEN 1 THEN 'live' ELSE 'backfill' END AS mode FROM events WHERE event_id % 3 < 2 OR ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def stream_late_data(spark, d):
    """Rows that the stream missed come with the second collection of the last seven days."""
    target, checkpoint = work_path(spark, "target"), work_path(spark, "checkpoint")
    e = _polls(spark, d, ["event_id % 3 = 0", "event_id % 3 = 1"], lambda stream: ingest.ingest(stream, target, checkpoint, keys=["event_id"], order=["ts"], ts="ts"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    for _ in range(2):  # a second time changes nothing
        ingest.reconcile(target, e, keys=["event_id"], order=["ts"], ts="ts", now=now)
    return ingest.read_target(spark, target, ingest.wider(e.schema, mode=T.StringType())).select("event_id", "mode")


@query("""
WITH a AS (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT user_id, epoch_us(ts) AS ts_us FROM events WHERE event_id % 2 = 0 UNION SELECT e.user_id, epoch_us(e.ts) FROM events e LEFT JOIN a USING (user_id) WHERE e.event_id % 2 = 1 AND (a.last IS NULL OR e.ts > a.last)""")
def stream_newer_bars(spark, d):
    """Of the second poll only bars newer than the last known one of their instrument."""
    target, checkpoint = work_path(spark, "target"), work_path(spark, "checkpoint")
    e = _polls(spark, d, ["event_id % 2 = 0", "event_id % 2 = 1"], lambda stream: ingest.newer_bars(stream, target, checkpoint, key="user_id", ts="ts", order=["event_id"]))
    return ingest.read_target(spark, target, e.schema).select("user_id", micros("ts").alias("ts_us"))


@query("""
SELECT event_id, CASE WHEN value >= 50 THEN 'LARGE' ELSE 'SMALL' END AS event_type, CASE WHEN user_id % 4 <= 2 THEN user_id END AS security_id,
  CASE WHEN user_id % 4 <= event_id % 3 THEN 1 WHEN user_id % 4 <= 2 THEN user_id % 4 - event_id % 3 + 1 ELSE 3 - event_id % 3 END AS tries FROM events""")
def stream_hand_off(spark, d):
    """Links become known batch by batch: those of user_id % 4 = n with batch n, and the last quarter never."""
    target, checkpoint = work_path(spark, "target"), work_path(spark, "checkpoint")
    link = lambda rows, batch: rows.withColumn("security_id", F.when(F.col("user_id") % 4 <= batch, F.col("user_id")))
    classify = F.when(F.col("value") >= 50, "LARGE").otherwise("SMALL")
    e = _polls(spark, d, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], lambda stream: ingest.hand_off(stream, target, checkpoint, key="event_id", classify=classify, link=link, ts="ts"))
    tried = ingest.read_target(spark, target, ingest.wider(e.schema, security_id=T.LongType(), tries=T.IntegerType()))
    last = tried.groupBy("event_id").agg(F.max_by(F.struct("event_type", "security_id", "tries"), "tries").alias("r"))
    return last.select("event_id", "r.*")


@query("""
SELECT event_type, epoch_us(date_trunc('minute', ts)) AS minute_us, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks
FROM events WHERE epoch_us(date_trunc('minute', ts)) + 60000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3000000 FROM events) GROUP BY event_type, date_trunc('minute', ts)""")
def stream_minute_bars(spark, d):
    """Only minutes that have ended, and their margin, are given out."""
    target, checkpoint = work_path(spark, "bars"), work_path(spark, "checkpoint")
    _polls(spark, d, ["true"], lambda stream: ingest.append_to(ingest.minute_bars(stream, key="event_type", ts="ts", value="value", order="event_id"), target, checkpoint))
    return spark.read.parquet(target).select("event_type", micros("minute").alias("minute_us"), "open", "high", "low", "close", "ticks")


_HANDED = """
WITH f AS (SELECT event_id, ts AS known, CASE WHEN user_id % 5 <> 0 THEN user_id END AS security_id, CASE WHEN event_id % 3 > 0 THEN ts + to_seconds((event_id % 1500)::INTEGER) END AS facts_at FROM events)
SELECT event_id, epoch_us(CASE WHEN facts_at <= known + INTERVAL 900 SECOND THEN facts_at ELSE known + INTERVAL 900 SECOND END) AS handed_us, CASE WHEN security_id IS NULL THEN 'dropped' WHEN facts_at <= known + INTERVAL 900 SECOND THEN 'with_facts' ELSE 'without_facts' END AS outcome FROM f"""


@query(_HANDED)
def handed_over(spark, d):
    e = table(spark, d, "events")
    filings = e.select("event_id", F.col("ts").alias("known"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("security_id"))
    facts = e.where("event_id % 3 > 0").select("event_id", F.timestamp_micros(micros("ts") + F.col("event_id") % 1500 * 1_000_000).alias("facts_at"))
    return ingest.handed_over(filings, facts, "event_id", "known", "facts_at").select("event_id", F.unix_micros("handed_at").alias("handed_us"), "outcome")


@query(_HANDED)
def stream_handed_over(spark, d):
    """The same of filings and facts that come in turn, over three runs with state and timers; a last tick lets the waits end."""
    e = table(spark, d, "events")
    filings = e.select("event_id", F.col("ts").alias("at"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("security_id"), F.lit("filing").alias("kind"))
    facts = e.where("event_id % 3 > 0").select("event_id", F.timestamp_micros(micros("ts") + F.col("event_id") % 1500 * 1_000_000).alias("at"), F.lit(None).cast("long").alias("security_id"), F.lit("facts").alias("kind"))
    rows = filings.unionByName(facts)
    tick = rows.agg((F.max("at") + F.expr("interval 1 day")).alias("at")).select(F.lit(-1).cast("long").alias("event_id"), "at", F.lit(None).cast("long").alias("security_id"), F.lit("filing").alias("kind"))
    folder, target, checkpoint = work_path(spark, "landing"), work_path(spark, "target"), work_path(spark, "checkpoint")
    cuts = ["1970-01-01", "2024-01-08", "2024-01-19 12:34:56", "9999-01-01"]
    for start, end in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.col("at") >= F.lit(start).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp")))
        (part.unionByName(tick) if end == cuts[-1] else part).write.mode("append").parquet(folder)
        stream = ingest.landing(spark, folder, rows.schema)
        out = stateful.hand_over(stream.where("kind = 'filing'").withColumnRenamed("at", "known"), stream.where("kind = 'facts'").withColumnRenamed("at", "facts_at"), key="event_id", known="known", security="security_id", facts_at="facts_at")
        stateful.run_with_state(out, lambda s: ingest.append_to(s, target, checkpoint))
    return spark.read.parquet(target)


_GROUPS = """
WITH RECURSIVE w AS (SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 6 HOUR AND ts < TIMESTAMP '2024-01-12' + INTERVAL 6 HOUR),
pr AS (SELECT l.event_id AS a, r.event_id AS b, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap FROM w l JOIN w r USING (user_id) WHERE l.event_id % 2 = 0 AND r.event_id % 2 = 1 AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 21600000000),
o AS (SELECT *, row_number() OVER (ORDER BY gap, a, b) AS k FROM pr),
g(k, used, taken) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT o.k, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM g JOIN o ON o.k = g.k + 1),
m AS (SELECT a AS event_id, least(a, b) AS grp FROM g JOIN o USING (k) WHERE taken UNION ALL SELECT b, least(a, b) FROM g JOIN o USING (k) WHERE taken)
SELECT event_id, coalesce(grp, event_id) AS event_group_id FROM events LEFT JOIN m USING (event_id) WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'"""


@query(_GROUPS)
def dedupe_range(spark, d):
    """Two days' filings of two sources, with six hours around them."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"))
    day = lambda x: F.lit(x).cast("timestamp")
    return identity.group_range(e, key="event_id", by=["user_id"], ts="ts", source="source", sources=("a", "b"), start=day("2024-01-10"), end=day("2024-01-12"))


@query(_GROUPS)
def stream_dedupe(spark, d):
    """The same of two sources that come in turn: candidates by a join of both streams, of which each batch matches the groups again that it touches."""
    day = lambda x: F.lit(x).cast("timestamp")
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    around = e.where((F.col("ts") >= day("2024-01-10") - F.expr("interval 6 hours")) & (F.col("ts") < day("2024-01-12") + F.expr("interval 6 hours")))
    folder, target, checkpoint = work_path(spark, "landing"), work_path(spark, "target"), work_path(spark, "checkpoint")
    cuts = ["1970-01-01", "2024-01-10 20:00:00", "2024-01-11 13:00:00", "9999-01-01"]
    for start, end in zip(cuts, cuts[1:], strict=False):
        around.where((F.col("ts") >= day(start)) & (F.col("ts") < day(end))).write.mode("append").parquet(folder)
        stream = ingest.landing(spark, folder, e.schema)
        stateful.match_live(stream.where("event_id % 2 = 0"), stream.where("event_id % 2 = 1"), target, checkpoint, by=["user_id"], ts="ts", key="event_id", max_gap_s=21_600)
    inside = around.where((F.col("ts") >= day("2024-01-10")) & (F.col("ts") < day("2024-01-12"))).select("event_id")
    found = inside.join(stateful.partners(spark, target, "event_id"), "event_id", "left")
    return found.select("event_id", F.coalesce(F.least("event_id", "partner"), "event_id").alias("event_group_id"))
