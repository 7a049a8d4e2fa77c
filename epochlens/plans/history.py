"""Queries: versions out of snapshots that came late, and names as they were known."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.operators import identity, merge, symbols, versions
from epochlens.plans.registry import query, table

#: Six snapshots of customers, ten days apart, of three lists (by custkey % 3); each lacks some keys, and the fourth of list 1 is cut short.
_DAYS = [f"2024-01-{1 + 10 * i:02d}" if i < 3 else f"2024-02-{10 * (i - 3) + 1:02d}" for i in range(6)]
_SNAPSHOTS_SQL = """
g AS (SELECT range AS i, CASE WHEN range < 3 THEN DATE '2024-01-01' + (10 * range)::INTEGER ELSE DATE '2024-02-01' + (10 * (range - 3))::INTEGER END AS day FROM range(6)),
sn AS (SELECT c_custkey % 3 AS list, i, day, c_custkey AS k, CASE WHEN (c_custkey + i) % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg FROM customer, g
  WHERE (c_custkey * 5 + i * 3) % 40 <> 0 AND NOT (c_custkey % 3 = 1 AND i = 3 AND c_custkey % 10 <> 1) AND NOT (c_custkey % 3 = 2 AND i = 2))"""


def _snapshots(spark, d):
    days = F.array(*(F.lit(x).cast("date") for x in _DAYS))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", F.posexplode(days).alias("i", "day"))
    k, i = F.col("k"), F.col("i")
    kept = c.where(((k * 5 + i * 3) % 40 != 0) & ~((k % 3 == 1) & (i == 3) & (k % 10 != 1)) & ~((k % 3 == 2) & (i == 2)))
    return kept.select((k % 3).alias("list"), "i", "day", "k", F.when((k + i) % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("seg"))


@query(f"""WITH RECURSIVE {_SNAPSHOTS_SQL},
st AS (
  SELECT -1::BIGINT AS i, NULL::BIGINT AS list, NULL::BIGINT AS k, NULL::VARCHAR AS seg, NULL::DATE AS f, NULL::DATE AS t, NULL::BIGINT AS n
  UNION ALL
  SELECT x.i, x.list, x.k, p.seg, p.f, p.t, x.n FROM (
    SELECT g.i, g.day, coalesce(o.list, s.list) AS list, coalesce(o.k, s.k) AS k, o.seg AS os, o.f, s.seg AS ss, s.k IS NOT NULL AS listed, o.k IS NOT NULL AS known,
      count(s.k) OVER (PARTITION BY coalesce(o.list, s.list)) AS n, count(o.k) OVER (PARTITION BY coalesce(o.list, s.list)) AS opened
    FROM (SELECT DISTINCT i + 1 AS i FROM st WHERE i < 5) now JOIN g ON g.i = now.i
      CROSS JOIN (SELECT list, k FROM (SELECT list, k FROM st WHERE k IS NOT NULL AND t IS NULL UNION SELECT sn.list, sn.k FROM sn JOIN (SELECT DISTINCT i + 1 AS i FROM st) n2 ON sn.i = n2.i)) ks
      LEFT JOIN (SELECT * FROM st WHERE k IS NOT NULL AND t IS NULL) o ON o.list = ks.list AND o.k = ks.k
      LEFT JOIN sn s ON s.i = g.i AND s.list = ks.list AND s.k = ks.k
  ) x, LATERAL (SELECT unnest(CASE
      WHEN NOT known THEN [{{'seg': ss, 'f': day, 't': NULL::DATE}}]
      WHEN NOT listed THEN [{{'seg': os, 'f': f, 't': CASE WHEN n > 0 AND n >= 0.95 * opened THEN day END}}]
      WHEN os = ss THEN [{{'seg': os, 'f': f, 't': NULL::DATE}}]
      ELSE [{{'seg': os, 'f': f, 't': day}}, {{'seg': ss, 'f': day, 't': NULL::DATE}}] END, recursive := true)) p
)
SELECT k, seg, f::VARCHAR AS valid_from, t::VARCHAR AS valid_to FROM st WHERE k IS NOT NULL AND (t IS NOT NULL OR i = 5)""")
def scd2_rebuild(spark, d):
    """Versions out of all six snapshots of three lists at once, one of them cut short and one empty; SQL applies them day by day."""
    rows = _snapshots(spark, d)
    taken = rows.select("list").distinct().select("list", F.explode(F.array(*(F.lit(x).cast("date") for x in _DAYS))).alias("day"))
    out = versions.rebuild(rows, taken, owner=["list"], keys=["k"], attrs=["seg"], as_of="day")
    return out.select("k", "seg", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query(f"""WITH {_SNAPSHOTS_SQL},
a AS (SELECT list, k, seg FROM sn WHERE i = 0), c AS (SELECT list, k, seg FROM sn WHERE i = 4), l AS (SELECT k, seg FROM sn WHERE i = 1 AND list = 0),
v1 AS (
  SELECT a.list, a.k, a.seg, DATE '2024-01-01' AS f, CASE WHEN c.k IS NULL OR c.seg <> a.seg THEN DATE '2024-02-11' END AS t FROM a LEFT JOIN c USING (k)
  UNION ALL SELECT c.list, c.k, c.seg, DATE '2024-02-11', NULL FROM c LEFT JOIN a USING (k) WHERE a.k IS NULL OR a.seg <> c.seg
), held AS (SELECT * FROM v1 WHERE list = 0 AND f <= DATE '2024-01-11' AND (t IS NULL OR t > DATE '2024-01-11')),
guard AS (SELECT (SELECT count(*) FROM l) >= 0.95 * (SELECT count(*) FROM held) AS whole),
nx AS (SELECT k, min(f) AS f FROM v1 WHERE list = 0 AND f > DATE '2024-01-11' GROUP BY 1)
SELECT k, seg, f::VARCHAR AS valid_from, t::VARCHAR AS valid_to FROM (
  SELECT k, seg, f, t FROM v1 WHERE NOT (list = 0 AND f <= DATE '2024-01-11' AND (t IS NULL OR t > DATE '2024-01-11'))
  UNION ALL SELECT h.k, h.seg, h.f, CASE WHEN l.k IS NULL THEN CASE WHEN whole THEN DATE '2024-01-11' ELSE h.t END WHEN l.seg = h.seg THEN h.t ELSE DATE '2024-01-11' END FROM held h LEFT JOIN l USING (k), guard
  UNION ALL SELECT l.k, l.seg, DATE '2024-01-11', CASE WHEN h.k IS NOT NULL THEN h.t ELSE nx.f END FROM l LEFT JOIN held h USING (k) LEFT JOIN nx USING (k) WHERE h.k IS NULL OR h.seg <> l.seg)""")
def scd2_late(spark, d):
    """The first and the fifth snapshot, then the second one, late, of one list only: it ends its versions at the next known ones and leaves other lists alone."""
    rows = _snapshots(spark, d)
    day = lambda i: F.lit(_DAYS[i]).cast("date")
    none = rows.limit(0).select("list", "k", "seg", F.col("day").alias("valid_from"), F.col("day").alias("valid_to"))
    now = none
    for i in (0, 4):
        now = merge.scd2_apply(now, rows.where(F.col("i") == i).select("list", "k", "seg"), keys=["list", "k"], attrs=["seg"], as_of=day(i), least_share=0.5)
    late = rows.where("i = 1 and list = 0").select("list", "k", "seg")
    out = merge.scd2_apply(now, late, keys=["list", "k"], attrs=["seg"], as_of=day(1), scope=F.col("list") == 0)
    return out.select("k", "seg", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


#: Renames made of customers among 200 symbols, which are used again and again; a fifth are learned of only weeks after their day. One change a symbol, direction and day.
_RENAMES_SQL = """
r0 AS (SELECT c_custkey AS k, 'S' || (c_custkey % 200) AS o, 'S' || ((c_custkey * 7 + 3) % 200) AS n, DATE '2024-01-01' + ((c_custkey * 11) % 360)::INTEGER AS d FROM customer),
r1 AS (SELECT * FROM (SELECT *, min(k) OVER (PARTITION BY o, d) AS a, min(k) OVER (PARTITION BY n, d) AS b FROM r0) WHERE k = a AND k = b AND o <> n AND k % 5 <> 0),
q AS (SELECT event_id, 'S' || (user_id % 200) AS symbol, ts::DATE + (event_id % 150)::INTEGER AS known_on, ts::DATE + (event_id % 360)::INTEGER - 60 AS target FROM events)"""


def _renames(spark, d):
    k = F.col("c_custkey")
    start = F.lit("2024-01-01").cast("date")
    c = table(spark, d, "customer").select(k, F.concat(F.lit("S"), k % 200).alias("old"), F.concat(F.lit("S"), (k * 7 + 3) % 200).alias("new"), F.date_add(start, ((k * 11) % 360).cast("int")).alias("effective"))
    first = lambda c: F.min("c_custkey").over(W.partitionBy(c, "effective"))
    c = c.withColumn("_a", first("old")).withColumn("_b", first("new")).where("c_custkey = _a and c_custkey = _b")
    # seen before their day, but for a fifth that came after all else
    store = c.select("old", "new", "effective").limit(0).withColumn("available_at", F.lit(None).cast("timestamp"))
    for late, fetched in ((False, "2023-12-01"), (True, "2026-01-01")):
        part = c.where((k % 5 == 0) == F.lit(late)).drop("c_custkey", "_a", "_b")
        store = symbols.record_changes(store, part, F.lit(fetched).cast("timestamp")) if not late else store.unionByName(part.withColumn("available_at", F.lit(fetched).cast("timestamp")))
    e = table(spark, d, "events")
    i, day = F.col("event_id"), F.to_date("ts")
    asked = e.select(i, F.concat(F.lit("S"), F.col("user_id") % 200).alias("symbol"), F.date_add(day, (i % 150).cast("int")).alias("known_on"), F.date_add(day, (i % 360 - 60).cast("int")).alias("target"))
    return asked, store, F.lit("2025-12-31").cast("timestamp")


@query(f"""WITH RECURSIVE {_RENAMES_SQL},
w AS (
  SELECT event_id, symbol, known_on AS day, target, target < known_on AS back, 0 AS step FROM q
  UNION ALL
  SELECT w.event_id, CASE WHEN back THEN arg_max(c.o, c.d) ELSE arg_min(c.n, c.d) END, CASE WHEN back THEN max(c.d) - 1 ELSE min(c.d) END, target, back, step + 1
  FROM w JOIN r1 c ON CASE WHEN back THEN c.n = w.symbol AND c.d > target AND c.d <= w.day ELSE c.o = w.symbol AND c.d > w.day AND c.d <= target END GROUP BY w.event_id, target, back, step
)
SELECT event_id, arg_max(symbol, step) AS symbol_then FROM w GROUP BY event_id""")
def symbol_chain(spark, d):
    """The symbol on another day of what was a symbol on one day, by the changes known at the end of 2025."""
    asked, store, as_of = _renames(spark, d)
    return symbols.symbol_on(asked, store, known_on="known_on", target="target", as_of=as_of).select("event_id", "symbol_then")


@query(f"""WITH RECURSIVE {_RENAMES_SQL}, a AS (SELECT DISTINCT symbol, known_on FROM q WHERE event_id % 4 = 0),
b AS (
  SELECT symbol AS s, known_on AS k, symbol AS name, known_on AS day, NULL::DATE AS start, 0 AS step FROM a
  UNION ALL
  SELECT b.s, b.k, arg_max(c.o, c.d), max(c.d) - 1, max(c.d), step - 1 FROM b JOIN r1 c ON c.n = b.name AND c.d <= b.day GROUP BY b.s, b.k, step
), f AS (
  SELECT symbol AS s, known_on AS k, symbol AS name, known_on AS day, 0 AS step FROM a
  UNION ALL
  SELECT f.s, f.k, arg_min(c.n, c.d), min(c.d), step + 1 FROM f JOIN r1 c ON c.o = f.name AND c.d > f.day GROUP BY f.s, f.k, step
), bs AS (SELECT s, k, name, step, lead(start) OVER (PARTITION BY s, k ORDER BY step DESC) AS start, day, step = min(step) OVER (PARTITION BY s, k) AS oldest FROM b),
ch AS (
  SELECT s, k, name, step, CASE WHEN oldest THEN (SELECT max(c.d) FROM r1 c WHERE c.o = bs.name AND c.d <= bs.day) ELSE start END AS start FROM bs
  UNION ALL SELECT s, k, name, step, day FROM f WHERE step > 0
)
SELECT s AS symbol, k::VARCHAR AS known_on, name, start::VARCHAR AS valid_from, (lead(start) OVER (PARTITION BY s, k ORDER BY step))::VARCHAR AS valid_to FROM ch""")
def symbol_chain_windows(spark, d):
    """All symbols of a listing with their windows; a symbol that is used again starts when its earlier holder left it."""
    asked, store, as_of = _renames(spark, d)
    asked = asked.where("event_id % 4 = 0").select("symbol", "known_on").distinct()
    found = symbols.symbol_windows(asked, store, known_on="known_on", as_of=as_of)
    return found.select("symbol", F.col("known_on").cast("string"), "name", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query("""
WITH RECURSIVE g AS (SELECT c_custkey AS old, CASE WHEN c_custkey % 7 = 1 THEN 1 ELSE 2 END AS build, c_custkey // 3 AS new FROM customer WHERE c_custkey % 3 = 1 AND c_custkey > 3),
w AS (SELECT c_custkey AS id, c_custkey AS now, 0 AS step FROM customer UNION ALL SELECT w.id, g.new, step + 1 FROM w JOIN g ON g.old = w.now),
e AS (SELECT id, arg_max(now, step) AS now, max(step) AS steps FROM w GROUP BY id)
SELECT id AS label, CASE WHEN now % 11 <> 0 THEN now END AS security_id, CASE WHEN now % 11 = 0 THEN 'split' WHEN steps > 0 THEN 'redirected' ELSE 'same' END AS id_status FROM e""")
def resolved_labels(spark, d):
    """Labels made under ids that have given way since, some of them several times; ids that were split say so."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    gone = c.where("c_custkey % 3 = 1 and c_custkey > 3").select(F.when(k % 7 == 1, 1).otherwise(2).alias("build"), F.floor(k / 3).alias("security_id"), k.alias("old"))
    merges = gone.groupBy("build", "security_id").agg(F.collect_list("old").alias("merged"))
    # ids divisible by 11 have members in two securities now
    previous = c.select(k.alias("security_id"), F.explode(F.array(F.concat(F.lit("a"), k), F.concat(F.lit("b"), k))).alias("node"))
    roots = previous.select("node", F.when(F.col("security_id") % 11 == 0, F.col("node")).otherwise(F.col("security_id").cast("string")).alias("root"))
    labels = c.select(k.alias("label"), k.alias("security_id"))
    return identity.resolve_ids(labels, identity.redirects(merges), identity.split_ids(roots, previous), "security_id")
