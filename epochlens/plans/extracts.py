"""Queries: filing texts, durations, names, outcomes of extraction, completeness and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.functions import extract, money
from epochlens.functions.scalars import r6, wilson
from epochlens.operators import asof
from epochlens.plans.registry import query, table


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ' | New   order | said' ELSE event_type || ' |   - 500123 - New order | said | Order Win' END AS text FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type || ' |   Co 7 - 500123 - New order | said | Order Win' FROM events WHERE event_id % 2 = 1""")
def filing_texts(spark, d):
    i = F.col("event_id")
    bse = i % 2 == 0
    subject = F.when(bse, F.lit("Acme Works Ltd - 500123 - New acme works order")).otherwise(F.lit("acme WORKS Co 7 - 500123 - New order"))
    text = extract.filing_text(F.when(bse, "BSE").otherwise("NSE"), F.col("event_type"), F.lit(""), subject, F.lit("said"), F.lit("Acme Works Limited"), F.lit("http://x/ACMEOrderWin_20240101.pdf"), F.lit("ACME"))
    return table(spark, d, "events").select("event_id", text.alias("text"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id BETWEEN 1 AND 600 THEN event_id::DOUBLE END WHEN 1 THEN CASE WHEN event_id * 12 <= 600 THEN event_id * 12.0 END WHEN 2 THEN CASE WHEN round(event_id / 30.4, 2) <= 600 THEN round(event_id / 30.4, 2) END
  WHEN 3 THEN CASE WHEN round(event_id / 4.35, 2) <= 600 THEN round(event_id / 4.35, 2) END WHEN 4 THEN round((DATE '2027-03-31' - (DATE '2024-01-01' + CAST(event_id % 300 AS INTEGER))) / 30.4, 1) ELSE round((DATE '2026-12-05' - (DATE '2024-01-01' + CAST(event_id % 300 AS INTEGER))) / 30.4, 1) END AS months FROM events""")
def durations(spark, d):
    i = F.col("event_id")
    text = F.lit("by 5th December 2026")
    for k, words in enumerate([" months", " years", " days", " weeks"]):
        text = F.when(i % 6 == k, F.concat(F.lit("within "), i, F.lit(words))).otherwise(text)
    text = F.when(i % 6 == 4, F.lit("up to 31.03.2027")).otherwise(text)
    filed = F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int"))
    return table(spark, d, "events").select("event_id", extract.duration_months(text, filed).alias("months"))


@query("""
SELECT c_custkey, c_custkey % 3 < 2 AS same, CASE c_custkey % 5 WHEN 0 THEN 'abstained' WHEN 1 THEN 'wrong' WHEN 2 THEN 'wrong' ELSE 'correct' END AS outcome FROM customer""")
def extraction_outcomes(spark, d):
    k = F.col("c_custkey")
    other = F.when(k % 3 == 0, F.concat(F.lit("M/S northern Rail "), k)).when(k % 3 == 1, F.concat(F.lit("The Northern Rail & "), k, F.lit(" Company Ltd."))).otherwise(F.concat(F.lit("Southern Rail "), k))
    said = F.when(k % 5 != 0, F.when(k % 5 == 1, 130.0).otherwise(100.9))
    true = F.when(k % 5 == 4, None).otherwise(F.lit(100.0))
    outcome = extract.amount_outcome(F.when(k % 5 == 4, None).otherwise(said), F.when(k % 5 == 2, "USD").otherwise("INR"), true, F.lit("INR"))
    return table(spark, d, "customer").select("c_custkey", extract.same_counterparty(F.concat(F.lit("Northern Rail "), k, F.lit(" Limited")), other).alias("same"), outcome.alias("outcome"))


@query("""
WITH o AS (SELECT o_orderpriority AS method, count(*) AS n, count(*) FILTER (o_orderkey % 4 > 0) AS k FROM orders GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM o)
SELECT method, n, k, floor(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0) * 1e6 + 0.5) / 1e6 AS low FROM p""")
def extraction_evaluation(spark, d):
    """Accuracy of each method with its interval."""
    o = table(spark, d, "orders")
    true = F.col("o_totalprice")
    outcome = extract.amount_outcome(true * F.when(F.col("o_orderkey") % 4 > 0, 1.002).otherwise(2.0), F.lit("INR"), true, F.lit("INR"))
    g = o.groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"), F.count_if(outcome == "correct").alias("k"))
    return g.select("method", "n", "k", r6(wilson(F.col("k"), F.col("n"))[0]).alias("low"))


@query("SELECT doc_id, sha256(replace(coalesce(lang, '') || chr(13) || chr(10) || 'x', chr(13) || chr(10), chr(10))) AS hash FROM documents")
def config_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.config_hash(F.concat(F.coalesce("lang", F.lit("")), F.lit("\r\nx"))).alias("hash"))


@query("""
SELECT o_custkey % 30 AS source, o_orderdate::DATE::VARCHAR AS day, count(*) AS got, max(CASE WHEN o_custkey % 30 < 20 THEN 1 ELSE 2 END) AS told, count(*) >= max(CASE WHEN o_custkey % 30 < 20 THEN 1 ELSE 2 END) AS complete FROM orders GROUP BY ALL""")
def page_completeness(spark, d):
    """A day's pages are complete when as many records have come as the exchange counts."""
    s = F.col("o_custkey") % 30
    g = table(spark, d, "orders").groupBy(s.alias("source"), F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("got"), F.max(F.when(s < 20, 1).otherwise(2)).alias("told"))
    return g.withColumn("complete", F.col("got") >= F.col("told"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'other_period' WHEN o_orderkey % 7 = 0 THEN 'other_nature' WHEN o_orderkey % 11 = 0 THEN 'no_revenue' ELSE 'ok' END AS status, o_orderkey % 4 >= 3 OR o_orderkey % 3 = 2 AS settled FROM orders""")
def acceptance_rules(spark, d):
    k = F.col("o_orderkey")
    end = F.to_date("o_orderdate")
    status = extract.xbrl_status(F.when(k % 5 == 0, F.date_add(end, 1)).when(k % 2 == 0, end), F.when(k % 7 == 0, F.lit(False)), end, F.lit(True), F.when(k % 11 != 0, F.col("o_totalprice")))
    settled = extract.day_settled(F.when(k % 4 > 0, k % 4), 3, end, F.date_add(end, (k % 3).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"), settled.alias("settled"))


@query("""
WITH f AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS source, CASE WHEN event_id % 4 = 0 THEN 'I' || user_id END AS isin FROM events),
w AS (SELECT DISTINCT user_id, user_id % 7 AS sec, TIMESTAMP '2024-01-01' + to_days((user_id % 9)::INTEGER) AS a FROM events)
SELECT event_id, CASE WHEN f.ts >= w.a THEN sec END AS security_id, CASE WHEN f.ts >= w.a THEN CASE WHEN source = 'BSE' THEN 'scrip' WHEN isin IS NOT NULL THEN 'isin' ELSE 'symbol' END END AS method FROM f JOIN w USING (user_id)""")
def filing_links(spark, d):
    """Of one exchange by ISIN at the event's time, else by symbol; of the other by its code; null where not exactly one security fits."""
    e = table(spark, d, "events")
    u = F.col("user_id")
    start = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(u % 9).cast("int"))
    every = e.select(u, (u % 7).alias("security_id"), start.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")).distinct()
    windows = every.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(p), u).alias("value")) for k, p in (("isin", "I"), ("symbol", "S"), ("scrip", "C"))))).alias("x"), "security_id", "valid_from", "valid_to").select("x.*", "security_id", "valid_from", "valid_to")
    i = F.col("event_id")
    kind = F.when(i % 2 == 1, "scrip").when(i % 4 == 0, "isin").otherwise("symbol")
    asked = e.select("event_id", "ts", kind.alias("kind"), F.concat(F.when(kind == "isin", "I").when(kind == "symbol", "S").otherwise("C"), u).alias("value"))
    found = asof.resolve_identifier(asked, windows, by=["kind", "value"], at="ts", target="security_id")
    return found.select("event_id", "security_id", F.when(F.col("security_id").isNotNull(), F.col("kind")).alias("method"))


@query("""
SELECT floor(greatest(quantile_cont(d, 0.95), 0) * 1e6 + 0.5) / 1e6 AS delay_s, count(*) AS n FROM (SELECT (event_id % 300) - 20 AS d FROM events WHERE event_id % 3 > 0) HAVING count(*) >= 100""")
def measured_delay(spark, d):
    """The delay of live rows, from a floor of zero; nothing is said of fewer than a hundred."""
    live = table(spark, d, "events").where("event_id % 3 > 0").select((F.col("event_id") % 300 - 20).alias("d"))
    return live.agg(r6(F.greatest(F.percentile("d", F.lit(0.95)), F.lit(0.0))).alias("delay_s"), F.count("*").alias("n")).where("n >= 100")


@query("""
SELECT o_orderkey, i, CASE i WHEN 0 THEN right('Order ' || o_orderkey || ' is worth ', 12) ELSE right('Order ' || o_orderkey || ' is worth Rs. ' || (o_orderkey % 97 + 1) || ' crore, of which ', 12) END AS before,
  CASE i WHEN 0 THEN 'Rs. ' || (o_orderkey % 97 + 1) || ' crore' ELSE 'USD ' || (o_orderkey % 11 + 1) || ' million' END AS amount, CASE i WHEN 0 THEN ', of which U' ELSE ' came at onc' END AS after FROM orders, (VALUES (0), (1)) v(i)""")
def amounts_in_context(spark, d):
    """Each amount with the twelve characters before and after it."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Order "), k, F.lit(" is worth Rs. "), k % 97 + 1, F.lit(" crore, of which USD "), k % 11 + 1, F.lit(" million came at once."))
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(money.amounts_in_context(text, 12)).alias("i", "x")).select("o_orderkey", "i", "x.*")
