"""Queries: scalar functions, rule classification, amounts, actions and identities, over texts made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.functions import actions, money, scalars, taxonomy
from epochlens.functions.scalars import r6
from epochlens.operators import identity
from epochlens.plans.registry import query, table


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


@query("""
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'x y ' || event_id END AS cleaned, CASE WHEN event_id % 5 <> 0 THEN event_id * 1000 + 0.5 END AS number, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id * 1000 + event_id * 1000 % 2 AS BIGINT) END AS whole,
  'v' || event_id AS picked, CAST(ts AS DATE)::VARCHAR AS day, epoch_us(ts) // 1000000 AS instant_s, user_id || '_' || event_type || '_1' AS path FROM events""")
def parsed_texts(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    messy = F.when(i % 4 == 0, F.lit(" N/A ")).otherwise(F.concat(F.lit("  x\t\n y  "), i, F.lit(" ")))
    number = F.when(i % 5 == 0, F.lit("-")).otherwise(F.concat(F.format_number(i * 1000, 0), F.lit(".5")))
    record = F.create_map(F.lit("First "), F.lit(" -- "), F.lit("SECOND"), F.concat(F.lit(" v"), i))
    day = F.when(i % 6 == 0, F.date_format("ts", "dd-MMM-yyyy")).when(i % 6 == 1, F.date_format("ts", "yyyy-MM-dd")).when(i % 6 == 2, F.date_format("ts", "dd-MM-yyyy")).when(i % 6 == 3, F.date_format("ts", "dd/MM/yyyy")).when(i % 6 == 4, F.upper(F.date_format("ts", "dd MMM yyyy"))).otherwise(F.date_format("ts", "yyyyMMdd"))
    local = F.from_utc_timestamp("ts", "+05:30")
    shapes = ["dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "ddMMyyyyHHmmss"]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    for k, shape in enumerate(shapes):
        stamp = F.when(i % 7 == k, F.date_format(local, shape)).otherwise(stamp)
    return e.select(
        "event_id", scalars.clean_text(messy).alias("cleaned"), scalars.to_number(number).alias("number"), scalars.to_whole(number).alias("whole"), scalars.pick(record, "first", "Second").alias("picked"),
        scalars.parse_date(day).cast("string").alias("day"), F.unix_seconds(scalars.parse_exchange_time(stamp)).alias("instant_s"), scalars.path_name(F.concat_ws("|", F.col("user_id").cast("string"), F.concat("event_type", F.lit("/: 1")))).alias("path"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * CAST(event_id % 86000 AS BIGINT) AS seconds, CASE WHEN event_id % 4 <> 0 THEN event_id % 20 / 100 END AS band, NOT (event_id % 5 = 0) AND event_id % 2 = 0 AS wanted,
  CASE WHEN event_id % 10 < 4 THEN 'train' WHEN event_id % 10 > 5 THEN 'test' END AS period, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'cancelled' END AS state, 'over the cap' AS reason FROM events""")
def small_scalars(spark, d):
    i = F.col("event_id")
    clock = F.concat(F.when(i % 3 == 0, F.lit("-")).otherwise(F.lit("")), F.date_format(F.timestamp_seconds(i % 86000), "HH:mm:ss"))
    name = F.concat(F.when(i % 2 == 0, F.lit("Order WIN of Co")).otherwise(F.lit("Board meeting")), F.when(i % 5 == 0, F.lit(" (Trading Window)")).otherwise(F.lit("")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 10).cast("int"))
    return table(spark, d, "events").select(
        "event_id", scalars.signed_duration(clock).alias("seconds"), scalars.band_fraction(F.when(i % 4 == 0, F.lit("No Band")).otherwise((i % 20).cast("string"))).alias("band"),
        scalars.wants_attachment(F.array(name), ["order win"], ["trading window"]).alias("wanted"), scalars.period(day, "2024-01-04", "2024-01-07").alias("period"),
        scalars.order_state(F.when(i % 3 == 0, F.lit("new")).when(i % 3 == 1, F.lit("partial")).otherwise(F.lit("filled")), F.when(i % 3 == 0, F.lit("accept")).otherwise(F.lit("cancel"))).alias("state"),
        scalars.refusal_reason(F.concat(F.lit("over the cap: "), i)).alias("reason"),
    )


@query(f"""
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, 400)), '[a-z]+'), lambda w: length(w) > 2 AND w <> 'the' AND w <> 'and')) AS t FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, list_distinct(list_transform(t, lambda w: CASE WHEN length(w) > 4 AND suffix(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END)) AS t FROM w)
SELECT a.doc_id, len(a.t) AS n, {_r6('coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0)')} AS alike FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def topics(spark, d):
    """Topic words of documents and how alike those of the next document are."""
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", scalars.topic_tokens(F.substring("text", 1, 400), F.lit(None).cast("string"), ["the", "and"]).alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(after, "doc_id").select("doc_id", F.size("t").cast("long").alias("n"), r6(scalars.jaccard(F.col("t"), F.col("u"))).alias("alike"))


RULES = [
    {"type": "ORDER_WIN", "when": [{"source": ["EDE"], "text": r"\border\b", "not_text": "cancel"}]},
    {"type": "RESULTS", "when": [{"text": r"\bresult"}, {"source": "NSE", "text": "audited"}]},
    {"type": "UPDATE", "generic_only": True, "when": [{"text": "update"}]},
    {"type": "NOISE", "when": [{"text": "loss of share"}]},
]
GENERIC = [{"text": "^general"}]
#: SQL of the same classification of subjects made of event ids.
_TYPED_SQL = """
sj AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'nse' ELSE 'ede' END AS source, CASE event_id % 8 WHEN 0 THEN 'New ORDER received' WHEN 1 THEN 'Order cancelled' WHEN 2 THEN 'Results for the quarter' WHEN 3 THEN 'Audited accounts' WHEN 4 THEN 'General update' WHEN 5 THEN 'Update' WHEN 6 THEN 'Loss of share certificate' END AS subject FROM events),
ty AS (SELECT *, CASE WHEN source = 'ede' AND event_id % 8 = 0 THEN 'ORDER_WIN' WHEN event_id % 8 = 2 OR (source = 'nse' AND event_id % 8 = 3) THEN 'RESULTS' WHEN event_id % 8 = 4 THEN 'UPDATE' WHEN event_id % 8 = 6 THEN 'NOISE' ELSE 'OTHER' END AS event_type FROM sj),
tn AS (SELECT *, CASE event_type WHEN 'ORDER_WIN' THEN 0 WHEN 'RESULTS' THEN 1 WHEN 'UPDATE' THEN 2 WHEN 'NOISE' THEN 3 ELSE 4 END AS rule_no FROM ty)"""


def _typed(spark, d):
    i = F.col("event_id")
    words = ["New ORDER received", "Order cancelled", "Results for the quarter", "Audited accounts", "General update", "Update", "Loss of share certificate"]
    subject = F.lit(None).cast("string")
    for k, w in enumerate(words):
        subject = F.when(i % 8 == k, F.lit(w)).otherwise(subject)
    e = table(spark, d, "events").select("event_id", "user_id", F.when(i % 3 == 0, "nse").otherwise("ede").alias("source"), subject.alias("subject"))
    return e.withColumn("t", taxonomy.compile_rules(RULES, GENERIC, {"source": F.col("source"), "text": F.col("subject")})).select("*", "t.*").drop("t")


@query(f"WITH {_TYPED_SQL} SELECT event_id, event_type, rule_no FROM tn")
def rule_classifier(spark, d):
    return _typed(spark, d).select("event_id", "event_type", "rule_no")


@query(f"""WITH {_TYPED_SQL}, tr AS (SELECT *, CASE event_type WHEN 'OTHER' THEN 0 WHEN 'NOISE' THEN 1 WHEN 'UPDATE' THEN 2 ELSE 3 END AS tier FROM tn)
SELECT user_id, arg_max(event_type, (tier, -rule_no)) AS event_type, count(*) AS filings FROM tr GROUP BY 1""")
def best_type_of_group(spark, d):
    return taxonomy.best_of_group(_typed(spark, d), "user_id", ["UPDATE"], ["NOISE"])


@query(f"WITH {_TYPED_SQL} SELECT event_type, count(*) AS n, {_r6('(SELECT count(*) FILTER (event_type = ' + chr(39) + 'OTHER' + chr(39) + ') / count(*) FILTER (event_type <> ' + chr(39) + 'NOISE' + chr(39) + ') FROM tn)')} AS other_share FROM tn GROUP BY 1")
def taxonomy_coverage(spark, d):
    return taxonomy.coverage(_typed(spark, d), ["NOISE"]).withColumn("other_share", r6(F.col("other_share")))


@query(f"WITH {_TYPED_SQL} SELECT source, subject, count(*) AS n FROM tn WHERE event_type = 'OTHER' GROUP BY ALL ORDER BY n DESC, source, subject LIMIT 3")
def unmapped_subjects(spark, d):
    """The most frequent subjects without a type; a report's limit."""
    other = _typed(spark, d).where("event_type = 'OTHER'").groupBy("source", "subject").agg(F.count("*").alias("n"))
    return other.orderBy(F.desc("n"), "source", F.col("subject").asc_nulls_last()).limit(3)


@query("SELECT event_id, 'Order Win ' || event_id % 100 || ' final' AS words FROM events")
def attachment_words(spark, d):
    i = F.col("event_id")
    name = F.concat(F.lit("https://x/docs/ACME"), F.lit("OrderWin_"), i % 100, F.lit("-final_20240105"), F.lit(".pdf"))
    return table(spark, d, "events").select("event_id", taxonomy.attachment_words(name, F.lit("ACME")).alias("words"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id + 0.5) * 1e7 WHEN 1 THEN event_id * 1e5 WHEN 2 THEN event_id * 1e6 ELSE NULL END AS amount, CASE event_id % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' END AS currency FROM events WHERE event_id > 0""")
def money_amounts(spark, d):
    """The first amount of a sentence."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("an order of Rs. "), F.format_number(i, 0), F.lit(".5 crore from a client"))).when(i % 4 == 1, F.concat(F.lit("worth "), i, F.lit(" lakhs, and 2 others"))).when(i % 4 == 2, F.concat(F.lit("for US$"), i, F.lit(" mn (12 units)"))).otherwise(F.concat(F.lit("orders "), i, F.lit(" units")))
    first = F.try_element_at(money.amounts(text), F.lit(1))
    return table(spark, d, "events").where("event_id > 0").select("event_id", first["amount"].alias("amount"), first["currency"].alias("currency"))


@query("""
SELECT p_brand AS symbol, (DATE '2020-01-01' + CAST(p_size % 5 AS INTEGER))::VARCHAR AS ex_date, floor(product(CASE WHEN p_partkey % 3 = 0 THEN 2.0 WHEN p_partkey % 3 = 1 THEN 5.0 ELSE 1 END) * 1e3 + 0.5) / 1e3 AS multiplier, bool_or(p_partkey % 7 = 0 AND p_partkey % 3 = 2) AS review FROM part WHERE p_partkey < 60 GROUP BY ALL""")
def action_adjustments(spark, d):
    k = F.col("p_partkey")
    subject = F.when(k % 3 == 0, F.lit("Bonus 1:1")).when(k % 3 == 1, F.lit("Face Value Split from Rs.10 to Rs.2")).when(k % 7 == 0, F.lit("Scheme of arrangement")).otherwise(F.lit("Dividend Rs 2"))
    rows = table(spark, d, "part").where("p_partkey < 60").select(F.col("p_brand").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size") % 5).alias("ex_date"), subject.alias("subject"))
    found = actions.adjustments(rows, "symbol", "ex_date", "subject")
    return found.select("symbol", F.col("ex_date").cast("string"), (F.floor(F.col("multiplier") * 1e3 + 0.5) / 1e3).alias("multiplier"), "review")


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS node, o_orderkey % 700 AS v FROM orders WHERE o_orderkey % 3 = 0), e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM o a JOIN o b USING (v))
SELECT node, min(v) AS root FROM (WITH RECURSIVE r(node, v) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.v) SELECT * FROM r) GROUP BY 1""")
def security_components(spark, d):
    """Listings that share an identifier, directly or through others, are one security."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 700).alias("v"))
    return identity.securities(o, "node", "v")


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS node, o_custkey % 40 AS root FROM orders), p AS (SELECT node, 1000 - node AS security_id FROM r WHERE node % 3 = 0),
h AS (SELECT root, min(security_id) AS kept, list_sort(list(DISTINCT security_id) FILTER (security_id IS NOT NULL)) AS held FROM r LEFT JOIN p USING (node) GROUP BY 1), n AS (SELECT root, row_number() OVER (ORDER BY root) AS k FROM h WHERE kept IS NULL)
SELECT root, coalesce(kept, (SELECT max(security_id) FROM p) + k) AS security_id, coalesce(list_filter(held, lambda x: x <> kept), []) AS merged FROM h LEFT JOIN n USING (root)""")
def stable_security_ids(spark, d):
    """A component keeps the smallest id that it had; new ones get ids after the last."""
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("node"), (F.col("o_custkey") % 40).alias("root")).distinct()
    previous = nodes.where("node % 3 = 0").select("node", (1000 - F.col("node")).alias("security_id"))
    return identity.stable_ids(nodes, previous).select("root", "security_id", "merged")


@query("SELECT o_custkey % 50 AS k, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS holder FROM orders GROUP BY 1")
def newest_claims(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("holder"), "o_orderdate")
    return identity.newest_claim(o, ["k"], "holder", "o_orderdate")


@query("SELECT o_custkey % 50 AS k, arg_max(o_orderpriority, (o_orderdate, CAST(o_orderkey % 2 = 0 AS INTEGER), o_orderpriority)) AS name FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def display_names(spark, d):
    """The newest known name; the main source wins ties."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("name"), "o_orderdate", (F.col("o_orderkey") % 2 == 0).alias("main"))
    return identity.display(o, ["k"], "name", "o_orderdate", "main")


_PAIRS_SQL = """
l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 1),
pr AS (SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 AS gap_s FROM l JOIN r USING (user_id) WHERE abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1e6 <= 21600)"""


def _pairs(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return identity.band_pairs(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), by=["user_id"], ts="ts", max_gap_s=21600.0)


@query(f"WITH {_PAIRS_SQL} SELECT l_event_id, r_event_id, floor(gap_s + 0.5) AS gap_s, CASE WHEN gap_s <= 900 THEN 2.0 WHEN gap_s <= 7200 THEN 1.0 ELSE 0 END + 3.0 AS score FROM pr")
def scored_pairs(spark, d):
    """Filings of one security on two sources within six hours, with points for closeness and an agreeing size."""
    return _pairs(spark, d).select("l_event_id", "r_event_id", F.floor(F.col("gap_s") + 0.5).cast("double").alias("gap_s"), scalars.pair_score(F.lit("kb"), F.col("gap_s"), F.lit(0.0)).alias("score"))


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY gap_s, l_event_id, r_event_id) AS k FROM pr),
g(k, used, taken) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT o.k, CASE WHEN list_contains(used, l_event_id) OR list_contains(used, r_event_id) THEN used ELSE list_concat(used, [l_event_id, r_event_id]) END, NOT (list_contains(used, l_event_id) OR list_contains(used, r_event_id)) FROM g JOIN o ON o.k = g.k + 1)
SELECT l_event_id, r_event_id FROM g JOIN o USING (k) WHERE taken""")
def greedy_matching(spark, d):
    """One-to-one, the closest pairs first."""
    return identity.greedy_pairs(_pairs(spark, d), "l_event_id", "r_event_id", [F.col("gap_s"), F.col("l_event_id"), F.col("r_event_id")]).select("l_event_id", "r_event_id")


@query("SELECT event_id, CASE WHEN (event_id - event_id % 2) % 3 = 0 THEN event_id - event_id % 2 ELSE event_id END AS event_group_id FROM events WHERE event_id < 500")
def event_groups_of_pairs(spark, d):
    """A filing's event is the smaller id of its pair, or its own."""
    e = table(spark, d, "events").where("event_id < 500").select("event_id")
    pairs = e.where("event_id % 2 = 0 and event_id % 3 = 0").select(F.col("event_id").alias("l"), (F.col("event_id") + 1).alias("r"))
    return identity.event_group_ids(e, pairs, "event_id", "l", "r")
