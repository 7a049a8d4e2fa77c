"""Queries: histories and states known by the clock, coverage, work queues and health."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.functions.scalars import exchange_date, r6
from epochlens.operators import coverage, merge, pit
from epochlens.plans.registry import CALENDAR_SQL, micros, query, table
from epochlens.plans.reads import events_calendar

CLOCK = datetime(2024, 1, 15, tzinfo=timezone.utc)


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


@query("SELECT event_id, epoch_us(ts) AS ts_us, value FROM events WHERE user_id = 7 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-15' ORDER BY ts")
def history_of_one(spark, d):
    known = pit.AsOf(CLOCK).read(table(spark, d, "events").withColumn("available_at", F.col("ts")))
    return known.where("user_id = 7 and event_type = 'click' and ts >= timestamp '2024-01-03'").select("event_id", micros("ts").alias("ts_us"), "value")


@query("SELECT user_id, day::VARCHAR AS day, close, lag(close) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM (SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL) WHERE day BETWEEN DATE '2024-01-03' - 2 AND DATE '2024-01-12'")
def cross_section_with_lead(spark, d):
    """All symbols over a range and two days before it, so that the first day has its predecessor."""
    known = pit.AsOf(CLOCK).read(table(spark, d, "events").withColumn("available_at", F.col("ts")))
    day = known.groupBy("user_id", exchange_date(F.col("ts")).alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    part = day.where(F.col("day").between(F.date_sub(F.lit("2024-01-03").cast("date"), 2), F.lit("2024-01-12").cast("date")))
    return part.select("user_id", F.col("day").cast("string"), "close", F.lag("close").over(W.partitionBy("user_id").orderBy("day")).alias("previous"))


@query("SELECT e.event_id, e.user_id, c.c_mktsegment AS segment, epoch_us(e.ts) AS ts_us FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.ts >= TIMESTAMP '2024-01-05' AND e.ts < TIMESTAMP '2024-01-09' AND e.ts <= TIMESTAMP '2024-01-15'")
def linked_moments(spark, d):
    e = table(spark, d, "events").where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09'")
    known = pit.AsOf(CLOCK).read(e.withColumn("available_at", F.col("ts")))
    return known.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id")).select("event_id", "user_id", F.col("c_mktsegment").alias("segment"), micros("ts").alias("ts_us"))


@query("SELECT e.event_id, e.event_type, c.c_mktsegment AS segment FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = e.user_id WHERE e.event_type <> 'error' AND e.ts >= TIMESTAMP '2024-01-05' AND e.ts < TIMESTAMP '2024-01-20'")
def typed_filings(spark, d):
    """Typed rows of a range with their security, where they have one."""
    typed = table(spark, d, "events").where("event_type <> 'error' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return typed.join(table(spark, d, "customer").where("c_custkey % 3 = 0"), F.col("c_custkey") == F.col("user_id"), "left").select("event_id", "event_type", F.col("c_mktsegment").alias("segment"))


@query("""
WITH v AS (SELECT c_custkey AS k, c_mktsegment AS flag, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS a, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' + CAST(c_custkey % 20 + 6 AS INTEGER) END AS b FROM customer)
SELECT s.s, coalesce(list_sort(list(DISTINCT v.flag) FILTER (v.flag IS NOT NULL)), []) AS flags, bool_and(v.k % 4 < 2) AS all_restricted FROM (SELECT DISTINCT c_nationkey AS s FROM customer) s LEFT JOIN (SELECT c.c_nationkey AS s, v.* FROM v JOIN customer c ON c.c_custkey = v.k WHERE v.a <= DATE '2024-01-12' AND (v.b IS NULL OR v.b > DATE '2024-01-12')) v USING (s) GROUP BY 1""")
def surveillance_state(spark, d):
    """Lists in force of a symbol, and whether every one of its series is restricted; without a series nothing is said."""
    k = F.col("c_custkey")
    day = F.lit("2024-01-12").cast("date")
    a = F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int"))
    force = table(spark, d, "customer").where((a <= day) & ((k % 2 != 0) | (F.date_add(a, 6) > day)))
    now = force.groupBy(F.col("c_nationkey").alias("s")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("flags"), F.bool_and(k % 4 < 2).alias("all_restricted"))
    every = table(spark, d, "customer").select(F.col("c_nationkey").alias("s")).distinct()
    return every.join(now, "s", "left").select("s", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), "all_restricted")


@query("SELECT user_id, arg_max(props, (ts, event_id)) AS facts FROM events WHERE starts_with(event_type, 'p') AND props <> '{}' AND value > 10 GROUP BY 1")
def newest_extraction(spark, d):
    """The newest facts of each filing under a version with a literal prefix; empty ones don't count."""
    e = table(spark, d, "events").where(F.col("event_type").startswith("p") & (F.col("props") != "{}") & (F.col("value") > 10))
    return e.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("facts"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND event_id % 5 < 3 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 25")
def attachment_queue(spark, d):
    """The newest documents still to fetch: not given up, recent, a limit for each round."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "error") & (F.col("event_id") % 5 < 3) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return coverage.worst(e, [F.desc("ts"), F.desc("event_id")], 25).select("event_id")


@query("SELECT event_id, epoch_us(date_trunc('minute', ts)) AS minute_us FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-15 10:00:00' - INTERVAL 3 SECOND AND ts > TIMESTAMP '2024-01-15 04:00:00'")
def finished_bars(spark, d):
    """Minutes that ended a margin before they were asked for."""
    bars = table(spark, d, "events").withColumn("minute", F.date_trunc("minute", "ts")).where("ts > timestamp '2024-01-15 04:00:00'")
    return bars.where("minute + interval 1 minute <= timestamp '2024-01-15 10:00:00' - interval 3 seconds").select("event_id", micros("minute").alias("minute_us"))


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def newest_text(spark, d):
    """The newest text of a document that was read without error."""
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("""
WITH s AS (SELECT DISTINCT event_type AS source FROM events), a AS (SELECT source, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day FROM s),
l AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS day FROM events WHERE user_id % 2 = 0)
SELECT a.source, a.day::VARCHAR AS day FROM a LEFT JOIN l USING (source, day) WHERE l.day IS NULL AND isodow(a.day) < 6""")
def due_days(spark, d):
    e = table(spark, d, "events")
    sources = e.select(F.col("event_type").alias("source")).distinct()
    loaded = e.where("user_id % 2 = 0").select(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).distinct()
    settled = sources.select("source", F.explode(F.expr("sequence(date '2024-01-01', date '2024-02-10')")).alias("day")).where("weekday(day) >= 5")
    return coverage.due_days(sources, F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"), loaded, settled).select("source", F.col("day").cast("string"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AND o_orderkey % 3 < 2) OR (o_orderkey % 5 <> 0 AND o_custkey % 11 = 0)")
def stale_links(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    links = o.where("o_orderkey % 7 <> 0").select(k.alias("filing_id"), F.when(k % 5 != 0, F.col("o_custkey")).alias("security_id"), (k % 3).alias("build"))
    securities = o.select(F.col("o_custkey").alias("security_id")).distinct().withColumn("merged_into", F.when(F.col("security_id") % 11 == 0, 1))
    return coverage.stale_links(o.select(k.alias("filing_id")), links, securities, 2).select(F.col("filing_id").alias("o_orderkey"))


@query(f"""
WITH b AS (SELECT user_id % 4 AS security, user_id AS symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, value, ts, event_id FROM events),
w AS (SELECT DISTINCT user_id AS symbol, user_id % 4 AS security, DATE '2024-01-01' + CAST(user_id % 7 AS INTEGER) AS a, DATE '2024-01-01' + CAST(user_id % 7 + 9 AS INTEGER) AS z FROM events)
SELECT b.security, b.day::VARCHAR AS day, max(b.value) AS high, count(*) AS bars FROM b JOIN w USING (symbol, security) WHERE b.day >= w.a AND b.day < w.z GROUP BY ALL""")
def symbol_window_union(spark, d):
    """Bars of one security across its symbols, each only inside its window."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("security"), F.col("user_id").alias("symbol"), exchange_date(F.col("ts")).alias("day"), "value")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("symbol") % 7).cast("int"))
    windows = e.select("symbol", start.alias("a"), F.date_add(start, 9).alias("z")).distinct()
    return e.join(windows, "symbol").where("day >= a and day < z").groupBy("security", F.col("day").cast("string").alias("day")).agg(F.max("value").alias("high"), F.count("*").alias("bars"))


@query(f"""
WITH {CALENDAR_SQL}, r AS (SELECT day, session_no FROM cal WHERE session_no IS NOT NULL),
e AS (SELECT event_id, event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM events)
SELECT e.event_id, CASE WHEN r.day IS NULL THEN 'no_session' WHEN p.day IS NULL THEN 'no_previous' WHEN n.day IS NULL THEN 'no_next' END AS reason, p.day::VARCHAR AS previous, n.day::VARCHAR AS next
FROM e LEFT JOIN r ON r.day = e.day LEFT JOIN r p ON p.session_no = r.session_no - 1 LEFT JOIN r n ON n.session_no = r.session_no + 1""")
def event_windows(spark, d):
    """Each event's session and its neighbours, with the reason where there are none."""
    return _windows(spark, d).select("event_id", "reason", F.col("previous").cast("string"), F.col("next").cast("string"))


def _windows(spark, d):
    r = events_calendar(spark, d).where("session_no is not null").select("day", "session_no")
    around = r.select("day", F.lag("day").over(W.orderBy("session_no")).alias("previous"), F.lead("day").over(W.orderBy("session_no")).alias("next"), F.lit(True).alias("_s"))  # one row for each session of the calendar
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", exchange_date(F.col("ts")).alias("day")).join(F.broadcast(around), "day", "left")
    reason = F.when(F.col("_s").isNull(), "no_session").when(F.col("previous").isNull(), "no_previous").when(F.col("next").isNull(), "no_next")
    return e.withColumn("reason", reason)


@query(f"""
WITH {CALENDAR_SQL}, r AS (SELECT day, session_no FROM cal WHERE session_no IS NOT NULL),
e AS (SELECT event_id, event_type, user_id % 8 AS stock, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM events),
w AS (SELECT e.*, p.day AS a, n.day AS b FROM e JOIN r ON r.day = e.day JOIN r p ON p.session_no = r.session_no - 1 JOIN r n ON n.session_no = r.session_no + 1),
c AS (SELECT stock, day, count(*) AS bars FROM e GROUP BY ALL), x AS (SELECT event_id, event_type, unnest([a, day, b]) AS day, unnest([stock, stock, stock]) AS stock FROM w),
y AS (SELECT x.event_id, any_value(x.event_type) AS event_type, bool_and(coalesce(c.bars, 0) >= 4) AS covered FROM x LEFT JOIN c ON c.stock = x.stock AND c.day = x.day GROUP BY 1)
SELECT event_type, count(*) AS events, count(*) FILTER (covered) AS covered FROM y GROUP BY 1""")
def window_coverage(spark, d):
    """Events of which every session has its bars, by type."""
    w = _windows(spark, d).where("reason is null").select("event_id", "event_type", (F.col("user_id") % 8).alias("stock"), F.array("previous", "day", "next").alias("sessions"))
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("instrument"), exchange_date(F.col("ts")).alias("day")).agg(F.count("*").alias("bars"))
    found = coverage.window_coverage(w, counts, sessions="sessions", keys=["stock"], bars="bars", least=4)
    return found.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if("covered").alias("covered"))


@query("""
WITH w AS (SELECT 'I' || (o_custkey % 50) AS i, date_trunc('month', o_orderdate)::DATE AS m FROM orders)
SELECT i AS instrument, m::VARCHAR AS month FROM w UNION SELECT 'INDEX', m::VARCHAR FROM w""")
def months_needed(spark, d):
    w = table(spark, d, "orders").select(F.concat(F.lit("I"), F.col("o_custkey") % 50).alias("i"), F.array(F.to_date("o_orderdate")).alias("sessions"))
    return coverage.months_needed(w, sessions="sessions", instrument="i", index="INDEX").select("instrument", F.col("month").cast("string"))


@query(f"SELECT event_type, count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS linked, bool_and(user_id % 3 = 0) AS resolved FROM events GROUP BY 1")
def link_coverage(spark, d):
    return coverage.link_coverage(table(spark, d, "events").withColumn("security", F.when(F.col("user_id") % 3 == 0, F.col("user_id"))), "event_type", "security")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS linked FROM events GROUP BY 1 HAVING count(*) <> count(*) FILTER (event_id % 3 = 0) ORDER BY count(*) - count(*) FILTER (event_id % 3 = 0) DESC, user_id LIMIT 10")
def worst_links(spark, d):
    found = coverage.link_coverage(table(spark, d, "events").withColumn("security", F.when(F.col("event_id") % 3 == 0, F.col("user_id"))), "user_id", "security").where("not resolved")
    return coverage.worst(found, [F.desc(F.col("total") - F.col("linked")), F.col("user_id")], 10).select("user_id", "total", "linked")


@query("SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS listed FROM customer GROUP BY 1")
def identifier_coverage(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return coverage.membership(table(spark, d, "customer"), "c_custkey", known, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if("listed").alias("listed"))


@query(f"SELECT f AS field, CAST(k AS BIGINT) AS known, n AS total, {_r6('k / n')} AS share FROM (SELECT count(*) AS n, count(lang) AS a, count(source) AS b, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS c FROM documents) CROSS JOIN LATERAL (SELECT unnest(['lang', 'source', 'third']) AS f, unnest([a, b, c]) AS k)")
def field_coverage(spark, d):
    docs = table(spark, d, "documents").withColumn("third", F.when(F.col("doc_id") % 3 == 0, 1))
    return coverage.field_coverage(docs, ["lang", "source", "third"]).withColumn("share", r6(F.col("share")))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view') GROUP BY 1")
def coverage_by_type(spark, d):
    return table(spark, d, "events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, {_r6('count(*) FILTER (event_type = ' + chr(39) + 'error' + chr(39) + ') / count(*) FILTER (event_type <> ' + chr(39) + 'view' + chr(39) + ')')} AS other_share FROM events")
def unmapped_share(spark, d):
    """The share of rows without a type, of those that aren't noise."""
    e = F.col("event_type")
    return table(spark, d, "events").agg(F.count("*").alias("n"), r6(F.count_if(e == "error") / F.count_if(e != "view")).alias("other_share"))


@query("SELECT o_custkey % 20 AS account, count(*) AS orders, count(*) FILTER (o_orderstatus = 'P') AS refused, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS net FROM orders GROUP BY 1")
def run_status(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 20).alias("account")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("refused"), F.sum(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("net"))


@query("SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, epoch_us(max(ts)) AS last_us FROM events")
def data_fingerprint(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(f"WITH l AS (SELECT o_custkey % 40 AS design, arg_max(o_totalprice, o_orderkey) / 1e5 AS sharpe FROM orders GROUP BY 1) SELECT count(*) AS designs, {_r6('var_samp(sharpe)')} AS variance FROM l")
def trials(spark, d):
    """Distinct designs tried, and the variance of the Sharpe ratio over each one's latest run."""
    latest = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("design")).agg((F.max_by("o_totalprice", "o_orderkey") / 1e5).alias("sharpe"))
    return latest.agg(F.count("*").alias("designs"), r6(F.var_samp("sharpe")).alias("variance"))


@query("SELECT o_orderpriority AS method, count(*) FILTER (o_orderkey % 4 = 0) AS abstained, count(*) FILTER (o_orderkey % 4 <> 0 AND o_totalprice >= 100000) AS correct, count(*) FILTER (o_orderkey % 4 <> 0 AND o_totalprice < 100000) AS wrong FROM orders GROUP BY 1")
def extraction_scores(spark, d):
    """Of each method: right within one per cent, wrong, or without an answer."""
    said = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") * F.when(F.col("o_totalprice") >= 100000, 1.005).otherwise(1.5))
    close = F.abs(said - F.col("o_totalprice")) <= 0.01 * F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count_if(said.isNull()).alias("abstained"), F.count_if(close).alias("correct"), F.count_if(~close).alias("wrong"))


@query("SELECT source, count(*) AS docs, count(text) AS with_text, count(*) FILTER (strlen(text) < 400) AS thin FROM documents GROUP BY 1")
def text_coverage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count("text").alias("with_text"), F.count_if(F.octet_length("text") < 400).alias("thin"))


@query("SELECT o_custkey, max(o_orderdate)::DATE::VARCHAR AS newest FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-06-01' ORDER BY max(o_orderdate), o_custkey LIMIT 20")
def refresh_list(spark, d):
    """Symbols that are behind, the longest behind first; a round's limit."""
    newest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m")).where("m < timestamp '1998-06-01'")
    return coverage.worst(newest, [F.col("m"), F.col("o_custkey")], 20).select("o_custkey", F.to_date("m").cast("string").alias("newest"))


@query("SELECT coalesce(l.quality::VARCHAR, 'unlabelled') AS status, count(*) AS docs FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1")
def labelling_progress(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("status")).agg(F.count("*").alias("docs"))


@query("""
WITH f AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, max(ts) AS last FROM events), r AS (
  SELECT 'errors' AS code, 'error' AS level, 0 AS severity, bad > 0.05 * n AS holds FROM f UNION ALL SELECT 'stale', 'warning', 1, last < TIMESTAMP '2030-01-01' FROM f UNION ALL SELECT 'empty', 'error', 0, n = 0 FROM f UNION ALL SELECT 'many', 'note', 2, n > 10 FROM f)
SELECT code, level, severity FROM r WHERE holds""")
def health_rules(spark, d):
    facts = table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.max("ts").alias("last"))
    rules = [("many", "note", F.col("n") > 10), ("errors", "error", F.col("bad") > 0.05 * F.col("n")), ("stale", "warning", F.col("last") < F.lit("2030-01-01").cast("timestamp")), ("empty", "error", F.col("n") == 0)]
    return coverage.health(rules, facts)


@query(f"""
WITH b AS (SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS c, sum(value) AS w FROM events GROUP BY ALL),
p AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM b)
SELECT day::VARCHAR AS day, count(*) AS n, {_r6('avg(o / prev - 1)')} AS overnight_equal, {_r6('sum((o / prev - 1) * w) / sum(w)')} AS overnight_weighted, {_r6('avg(c / o - 1)')} AS intraday_equal, {_r6('sum((c / o - 1) * w) / sum(w)')} AS intraday_weighted, {_r6('avg(c / prev - 1)')} AS whole_equal, {_r6('sum((c / prev - 1) * w) / sum(w)')} AS whole_weighted FROM p WHERE prev > 0 AND o > 0 GROUP BY 1""")
def overnight_split(spark, d):
    at = F.struct("ts", "event_id")
    b = table(spark, d, "events").groupBy("user_id", exchange_date(F.col("ts")).alias("day")).agg(F.min_by("value", at).alias("o"), F.max_by("value", at).alias("c"), F.sum("value").alias("w"))
    b = b.withColumn("prev", F.lag("c").over(W.partitionBy("user_id").orderBy("day")))
    found = coverage.overnight_split(b, ["day"], opens="o", close="c", previous="prev", weight="w")
    return found.select(F.col("day").cast("string"), "n", *(r6(F.col(c)).alias(c) for c in found.columns[2:]))


@query("SELECT o_orderkey, o_orderpriority AS design FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey DESC LIMIT 5")
def previous_runs(spark, d):
    return coverage.worst(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), [F.desc("o_orderkey")], 5).select("o_orderkey", F.col("o_orderpriority").alias("design"))


@query("""
SELECT l_orderkey, l_partkey, min(CASE WHEN l_linenumber = 1 THEN l_tax END) AS ret_d0, min(CASE WHEN l_linenumber = 2 THEN l_tax END) AS ret_d1, min(CASE WHEN l_linenumber = 1 THEN l_discount END) AS cost_d0, min(CASE WHEN l_linenumber = 2 THEN l_discount END) AS cost_d1
FROM (SELECT l_orderkey, l_partkey, l_linenumber, min(l_tax) AS l_tax, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def wide_flatten(spark, d):
    exits = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_tax").alias("ret"), F.col("l_discount").alias("cost"), F.concat(F.lit("d"), F.col("l_linenumber") - 1).alias("exit"))
    return coverage.flattened(exits, ["l_orderkey", "l_partkey"], "exit", ["ret", "cost"], ["d0", "d1"])


@query("""
WITH f AS (SELECT event_id, event_type, user_id FROM events WHERE event_type <> 'view')
SELECT f.event_id, f.event_type, c.c_mktsegment AS linked, o.o_orderstatus AS text_status, CASE WHEN f.event_id % 3 = 0 THEN 'facts' END AS facts
FROM f LEFT JOIN customer c ON c.c_custkey = f.user_id LEFT JOIN orders o ON o.o_orderkey = f.event_id""")
def pipeline_state(spark, d):
    """Filing, type, link, text and facts side by side, whatever is there yet."""
    f = table(spark, d, "events").where("event_type <> 'view'").select("event_id", "event_type", "user_id")
    link = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("linked"))
    text = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("text_status"))
    facts = f.where("event_id % 3 = 0").select("event_id", F.lit("facts").alias("facts"))
    return f.join(link, "user_id", "left").join(text, "event_id", "left").join(facts, "event_id", "left").select("event_id", "event_type", "linked", "text_status", "facts")


@query("SELECT 'event' AS kind, event_id AS id, epoch_us(ts) AS at_us FROM events WHERE user_id = 3 UNION ALL SELECT 'order', o_orderkey, epoch_us(o_orderdate) FROM orders WHERE o_custkey = 3")
def mixed_union(spark, d):
    """Events and orders in one stream of records."""
    a = table(spark, d, "events").where("user_id = 3").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), micros("ts").alias("at_us"))
    return a.unionByName(table(spark, d, "orders").where("o_custkey = 3").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("at_us")))


@query("SELECT e.event_id, x.have FROM events e LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, true AS have FROM orders) x ON x.day = DATE '1995-01-01' + CAST(e.event_id % 400 AS INTEGER) WHERE x.have")
def existence_probe(spark, d):
    """Rows whose day has any row of the other table."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    e = table(spark, d, "events").withColumn("day", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 400).cast("int")))
    return e.join(days, "day", "left_semi").select("event_id", F.lit(True).alias("have"))


@query(f"""
WITH b AS (SELECT user_id, date_trunc('minute', ts) AS m, event_id, value FROM events), o AS (SELECT user_id, m, arg_max(value, event_id) AS v FROM b WHERE event_id % 3 < 2 GROUP BY ALL), n AS (SELECT user_id, m, arg_max(value, event_id) + 1 AS v FROM b WHERE event_id % 3 > 0 GROUP BY ALL)
SELECT coalesce(n.user_id, o.user_id) AS instrument, strftime(coalesce(n.m, o.m), '%Y-%m') AS month, count(*) AS bars, {_r6('sum(coalesce(n.v, o.v))')} AS total FROM o FULL JOIN n USING (user_id, m) GROUP BY ALL""")
def month_file_merge(spark, d):
    """A month file is written anew from its old bars and the new ones, of which the new ones win; only the months that have new bars are touched."""
    b = table(spark, d, "events").withColumn("at", F.date_trunc("minute", "ts"))
    last = lambda rows: rows.groupBy("user_id", "at").agg(F.max_by("value", "event_id").alias("v"))
    merged = merge.newer_wins(last(b.where("event_id % 3 < 2")), last(b.where("event_id % 3 > 0")).withColumn("v", F.col("v") + 1), ["user_id", "at"])
    return merged.groupBy(F.col("user_id").alias("instrument"), F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("bars"), r6(F.sum("v")).alias("total"))


@query("SELECT c_custkey, least(TIMESTAMP '2024-02-01 09:00:00', CAST(DATE '2024-01-25' + CAST(c_custkey % 20 AS INTEGER) AS TIMESTAMP) - INTERVAL 330 MINUTE)::VARCHAR AS known FROM customer")
def action_availability(spark, d):
    """An action is known when it was fetched, or at midnight of its ex-date on the exchange, whichever is first."""
    ex = F.date_add(F.lit("2024-01-25").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    midnight = F.to_utc_timestamp(ex.cast("timestamp"), "+05:30")
    return table(spark, d, "customer").select("c_custkey", F.least(F.lit("2024-02-01 09:00:00").cast("timestamp"), midnight).cast("string").alias("known"))


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) FILTER (o_orderpriority <> '5-LOW') AS attempts FROM orders GROUP BY 1")
def attachment_state(spark, d):
    """The latest status of each document; decisions of policy are no attempts."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("attempts"))


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT o_custkey, o_orderdate, sum(o_totalprice) AS revenue FROM orders WHERE o_orderkey % 3 = 1 GROUP BY ALL),
j AS (SELECT f.o_orderkey, f.o_totalprice, arg_max(r.revenue, r.o_orderdate) AS revenue FROM f LEFT JOIN r ON r.o_custkey = f.o_custkey AND r.o_orderdate < f.o_orderdate GROUP BY ALL)
SELECT o_orderkey, floor(o_totalprice / revenue * 1e6 + 0.5) / 1e6 AS amount_vs_revenue FROM j""")
def revenue_ratio(spark, d):
    """An amount over the newest revenue that was public before it; null where there is none."""
    from epochlens.operators import asof

    o = table(spark, d, "orders")
    facts = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"), "o_totalprice")
    revenue = o.where("o_orderkey % 3 = 1").groupBy("o_custkey", F.col("o_orderdate").alias("public")).agg(F.sum("o_totalprice").alias("revenue"))
    found = asof.asof_join(facts, revenue, by=["o_custkey"], left_ts="at", right_ts="public", take=["revenue"], direction="backward", allow_equal=False)
    return found.select("o_orderkey", r6(F.when(F.col("revenue") > 0, F.col("o_totalprice") / F.col("revenue"))).alias("amount_vs_revenue"))
