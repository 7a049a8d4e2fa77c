"""Queries: facts of order wins out of filings written around the orders table, and their scores. SQL says what was written, and reads no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.functions import orders
from epochlens.functions.scalars import r6, wilson
from epochlens.plans.registry import query, table
from epochlens.session import materialised

#: Six kinds of filings by orderkey: forms with their fields, with a blank field, with the end as a date; letters in rupees and dollars; and one without an amount.
_FACTS_SQL = """
b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 6 AS form, ((o_orderkey % 900 + 1) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0'))::DOUBLE AS x, o_orderkey % 50 + 1 AS n, o_orderdate::DATE AS filed FROM orders),
f AS (SELECT k, CASE form WHEN 0 THEN x * 1e7 WHEN 1 THEN x * 1e5 WHEN 2 THEN x * 1e7 WHEN 3 THEN x * 1e6 WHEN 5 THEN x * 1e5 END AS amount, CASE WHEN form = 3 THEN 'USD' WHEN form <> 4 THEN 'INR' END AS currency,
  CASE WHEN form IN (0, 5) THEN 'Client ' || c || ' Limited' END AS counterparty, CASE form WHEN 0 THEN 'domestic' WHEN 3 THEN 'export' WHEN 5 THEN 'export' ELSE 'unknown' END AS market,
  CASE WHEN form = 0 THEN n::DOUBLE WHEN form = 5 AND n % 2 = 0 THEN round((DATE '2026-12-31' - filed) / 30.4, 1) WHEN form = 5 THEN round((DATE '2027-03-05' - filed) / 30.4, 1) END AS months,
  CASE WHEN form = 5 THEN true END AS repeat, CASE WHEN form IN (0, 1, 5) THEN 'annexure' WHEN form IN (2, 3) THEN 'sentence' ELSE 'none' END AS method FROM b)"""


def _filings(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.concat((k % 900 + 1).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    n = k % 50 + 1
    of = "order(s)/contract(s)"
    form = lambda market, period, size: F.concat(
        F.lit(f"Disclosure under the regulations.  a) Name of the entity awarding the {of}:\n M/s. Client "), c, F.lit(f" Limited b) Significant terms and conditions of {of} awarded in brief Supply of 20 pumps c) Whether domestic or international {market} d) Nature of {of} Supply"
        f" e) Time period by which the {of} is to be executed "), period, F.lit(f" f) Broad consideration or size of the {of} "), size, F.lit(" g) Whether the promoter group has any interest No h) fall within related party transactions No"),
    )
    ends = F.when(n % 2 == 0, "on or before December 31, 2026").otherwise("till 5th March 2027")
    texts = [
        form("Domestic", F.concat(n, F.lit(" months")), F.concat(F.lit("Rs. "), x, F.lit(" crore"))),
        F.concat(F.lit(f"Name of the entity awarding the {of} NA Broad consideration or size of the {of} As agreed Whether the promoter group has an interest No. The order value is Rs. "), x, F.lit(" lakh plus taxes.")),
        F.concat(F.lit("The Company has a turnover of Rs. 900 crore from its orders. We are pleased to say that we have received purchase orders aggregating to Rs. "), x, F.lit(" crore from a client. The order was placed today with Rs. 5 crore on hand.")),
        F.concat(F.lit("We inform you of an export order worth USD "), x, F.lit(" million from an overseas client.")),
        F.lit("The board met today and spoke of the order book; nothing else was decided."),
        F.concat(form("International", ends, F.concat(F.lit("INR "), x, F.lit(" Lakhs"))), F.lit(". This is a repeat order.")),
    ]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(k % 6 == i, t).otherwise(text)
    return o.select(k.alias("k"), F.to_date("o_orderdate").alias("filed"), text.alias("text"))


def _facts(spark, d):
    return orders.order_wins(_filings(spark, d), "text", "filed").select("k", *(F.col(f"order.{c}").alias(c) for c in ("amount", "currency", "counterparty", "market", "months", "repeat", "method")))


@query(f"WITH {_FACTS_SQL} SELECT * FROM f")
def order_win_facts(spark, d):
    """Every filing's facts, and how they were found."""
    return _facts(spark, d)


@query(f"""WITH {_FACTS_SQL},
l AS (SELECT k, CASE WHEN k % 5 < 4 THEN 'rules' ELSE 'other' END AS shown, amount * CASE WHEN k % 4 = 1 THEN 1.02 ELSE 1.005 END AS wa, currency AS wc, CASE WHEN k % 12 = 0 THEN 'Another Company' ELSE counterparty END AS wn, market AS wm, months + CASE WHEN k % 12 < 6 THEN 0.4 ELSE 0 END AS wd, repeat AS wr FROM f WHERE k % 3 <> 1),
s AS (SELECT 'rules' AS method, shown = 'rules' AS shown_own, CASE WHEN wa IS NULL THEN 'correct' WHEN abs(amount - wa) <= 0.01 * wa THEN 'correct' ELSE 'wrong' END AS outcome, wn IS NOT DISTINCT FROM counterparty AS name, true AS market_ok, true AS months_ok, true AS repeat_ok FROM l JOIN f USING (k)
  UNION ALL SELECT 'blank', false, CASE WHEN wa IS NULL THEN 'correct' ELSE 'abstained' END, wn IS NULL, wm = 'unknown', wd IS NULL, wr IS NULL FROM l),
g AS (SELECT method, shown_own, count(*) AS n, count(*) FILTER (outcome = 'correct') AS amount, count(*) FILTER (outcome = 'abstained') AS abstained, count(*) FILTER (outcome = 'wrong') AS wrong_amount,
  count(*) FILTER (name) AS counterparty, count(*) FILTER (market_ok) AS market, count(*) FILTER (months_ok) AS months, count(*) FILTER (repeat_ok) AS repeat FROM s GROUP BY GROUPING SETS ((method, shown_own), (method)))
SELECT *, floor(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0) * 1e6 + 0.5) / 1e6 AS low FROM (SELECT *, amount / n AS p, 1.959963984540054 AS z FROM g)""".replace("SELECT *, floor", "SELECT * EXCLUDE (p, z), floor"))
def order_win_scores(spark, d):
    """The rules' facts and those of a method that says nothing against labels, of which some differ; over all, and by whose proposal was shown."""
    facts = materialised(_facts(spark, d), "facts").withColumn("label_method", F.lit("rules"))  # they are asked three times
    k = F.col("k")
    labels = facts.where("k % 3 <> 1").select(
        "k", F.lit("labelled").alias("status"), F.lit("new_order").alias("kind"), F.when(k % 5 < 4, "rules").otherwise("other").alias("shown"), (F.col("amount") * F.when(k % 4 == 1, 1.02).otherwise(1.005)).alias("amount"), "currency",
        F.when(k % 12 == 0, "Another Company").otherwise(F.col("counterparty")).alias("counterparty"), "market", (F.col("months") + F.when(k % 12 < 6, 0.4).otherwise(0.0)).alias("months"), "repeat",
    )
    others = facts.where("k % 3 = 1").select("k", F.lit("skipped").alias("status"), F.lit("new_order").alias("kind"), F.lit("rules").alias("shown"), "amount", "currency", "counterparty", "market", "months", "repeat")
    methods = spark.createDataFrame([("rules",), ("blank",)], "method string")
    found = orders.scores(labels.unionByName(others), facts.drop("method", "label_method").withColumn("method", F.lit("rules")), methods, "k")
    return found.withColumn("low", r6(wilson(F.col("amount"), F.col("n"))[0]))
