"""Queries: whole studies over the events table, with every reason in order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.functions.scalars import exchange_date, r6
from epochlens.operators import studies
from epochlens.plans.reads import events_calendar
from epochlens.plans.registry import CALENDAR_SQL, query, table

#: Filings are events; a security is a user, listed unless user_id % 9 = 0; its symbol changes on 2024-01-16; prices are made of its events of a day.
_MARKET = """
px AS (SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, sum(value) AS t FROM events GROUP BY ALL),
pr AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY day) AS pc, CASE WHEN day < DATE '2024-01-16' THEN 'A' ELSE 'B' END || user_id AS symbol FROM px),
ac AS (SELECT DISTINCT symbol, day, 2.0 AS m, user_id % 2 = 0 AS review FROM pr WHERE (user_id + (day - DATE '2024-01-01')) % 11 = 0)"""


def _market(spark, d):
    e = table(spark, d, "events").withColumn("day", exchange_date(F.col("ts")))
    at = F.struct("ts", "event_id")
    p = e.groupBy("user_id", "day").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("turnover"))
    p = p.withColumn("prev_close", F.lag("close").over(W.partitionBy("user_id").orderBy("day"))).withColumn("symbol", F.concat(F.when(F.col("day") < F.lit("2024-01-16").cast("date"), "A").otherwise("B"), "user_id"))
    actions = p.where((F.col("user_id") + F.datediff("day", F.lit("2024-01-01").cast("date"))) % 11 == 0).select("symbol", "day", F.lit(2.0).alias("multiplier"), (F.col("user_id") % 2 == 0).alias("review"))
    turn = F.lit("2024-01-16").cast("date")
    users = e.select(F.col("user_id").alias("security_id")).distinct().where("security_id % 9 <> 0")
    never = F.lit(None).cast("date")
    names = users.select("security_id", F.explode(F.array(F.struct(F.concat(F.lit("A"), "security_id").alias("symbol"), F.lit("1990-01-01").cast("date").alias("valid_from"), turn.alias("valid_to")), F.struct(F.concat(F.lit("B"), "security_id").alias("symbol"), turn.alias("valid_from"), never.alias("valid_to")))).alias("x")).select("security_id", "x.*")
    bench = e.groupBy("day").agg(F.avg("value").alias("open"), (F.avg("value") + 1).alias("close"))
    return e, p, names, actions, bench


_DAILY = f"""{CALENDAR_SQL}, {_MARKET},
ss AS (SELECT day, session_no AS n, open_ts FROM cal WHERE session_no IS NOT NULL), bn AS (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, avg(value) AS bo, avg(value) + 1 AS bc FROM events GROUP BY 1),
f0 AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN user_id END AS sec, user_id, event_id % 10 = 3 AS ex, CASE WHEN event_id % 8 = 5 THEN NULL ELSE value END AS amount FROM events),
f1 AS (SELECT f0.*, s.day AS entry, s.n FROM f0 ASOF LEFT JOIN ss s ON f0.ts < s.open_ts),
f2 AS (SELECT f1.*, CASE WHEN ex THEN 'excluded_category' WHEN entry IS NULL OR entry NOT BETWEEN DATE '2024-01-04' AND DATE '2024-01-26' THEN 'outside_window' WHEN sec IS NULL THEN 'unlinked' KEEP WHEN sec % 9 = 0 THEN 'no_nse_listing' END AS r1 FROM f1),
f3 AS (SELECT f2.*, p.symbol, p.o, p.h, p.l, p.pc FROM f2 LEFT JOIN pr p ON p.user_id = f2.sec AND p.day = f2.entry WHERE r1 IS NULL),
md AS (SELECT event_id, quantile_cont(coalesce(p.t, 0), 0.5) AS med FROM (SELECT event_id, sec, unnest(range(n - 4, n)) AS k FROM f3) x LEFT JOIN ss ON ss.n = x.k LEFT JOIN pr p ON p.user_id = x.sec AND p.day = ss.day GROUP BY 1),
f4 AS (SELECT f3.*, med, e5.day AS last_exit, coalesce(a.m, 1) AS m0 FROM f3 JOIN md USING (event_id) LEFT JOIN ss e5 ON e5.n = f3.n + 5 LEFT JOIN ac a ON a.symbol = f3.symbol AND a.day = f3.entry),
f5 AS (SELECT f4.*, EXISTS (SELECT 1 FROM ac WHERE ac.review AND ac.symbol = f4.symbol AND ac.day BETWEEN f4.entry AND f4.last_exit) AS rv FROM f4),
f6 AS (SELECT *, CASE WHEN symbol IS NULL OR pc IS NULL OR o IS NULL OR o <= 0 THEN 'no_entry_price' WHEN pc < 5 THEN 'low_price' WHEN med < 30 THEN 'illiquid' WHEN h = l THEN 'locked_entry' WHEN abs(o * m0 / pc - 1) >= 3 THEN 'circuit_gap' WHEN rv THEN 'review_action' END AS r2 FROM f5),
lv AS (SELECT *, row_number() OVER (PARTITION BY sec, event_type ORDER BY ts, event_id) AS k FROM f6 WHERE r2 IS NULL),
cd AS (WITH RECURSIVE w AS (SELECT sec, event_type, event_id, k, n AS last, true AS kept FROM lv WHERE k = 1 UNION ALL SELECT lv.sec, lv.event_type, lv.event_id, lv.k, CASE WHEN lv.n - w.last > 2 THEN lv.n ELSE w.last END, lv.n - w.last > 2 FROM w JOIN lv ON lv.sec = w.sec AND lv.event_type = w.event_type AND lv.k = w.k + 1) SELECT * FROM w),
f7 AS (SELECT f6.event_id, f6.event_type, f6.sec, f6.symbol, f6.entry, f6.n, f6.o, coalesce(r2, CASE WHEN NOT cd.kept THEN 'duplicate' END) AS reason FROM f6 LEFT JOIN cd USING (event_id)),
xt AS (SELECT f7.*, x.day AS exit_day, p.c AS close, b.bo, b2.bc FROM f7 LEFT JOIN ss x ON x.n = f7.n + 5 LEFT JOIN pr p ON p.user_id = f7.sec AND p.day = x.day LEFT JOIN bn b ON b.day = f7.entry LEFT JOIN bn b2 ON b2.day = x.day),
mu AS (SELECT xt.event_id, coalesce(product(ac.m), 1) AS m FROM xt LEFT JOIN ac ON ac.symbol = xt.symbol AND ac.day > xt.entry AND ac.day <= xt.exit_day GROUP BY 1),
al AS (SELECT event_id, event_type, entry, reason, CASE WHEN reason IS NULL THEN close * m / o - 1 END AS ret, CASE WHEN reason IS NULL THEN bc / bo - 1 END AS bench FROM xt JOIN mu USING (event_id) UNION ALL SELECT event_id, event_type, entry, r1, NULL, NULL FROM f2 WHERE r1 IS NOT NULL)"""
_RESULT = "SELECT event_id, entry::VARCHAR AS entry_day, reason, floor(ret * 1e6 + 0.5) / 1e6 AS ret, floor((ret - bench - 0.005) * 1e6 + 0.5) / 1e6 AS net FROM al"


def _daily(spark, d, keep=None):
    e, prices, names, actions, bench = _market(spark, d)
    i = F.col("event_id")
    filings = e.select(i.alias("filing_id"), "event_type", F.when(i % 10 == 3, "Newspaper").otherwise("Order").alias("category"), F.col("ts").alias("available_at"), F.when(i % 7 != 0, F.col("user_id")).alias("security_id"), F.when(i % 8 != 5, F.col("value")).alias("amount"))
    found = studies.daily_study(
        filings, names, prices.drop("user_id"), bench, actions, events_calendar(spark, d), first="2024-01-04", last="2024-01-26", exits={"d1": 1, "d5": 5}, excluded=["newspaper"], lookback=4, least_turnover=30, least_price=5, most_gap=3, cooldown=2, round_trip=0.005, keep=keep
    )
    return found.select(F.col("filing_id").alias("event_id"), F.col("entry_day").cast("string"), "reason", r6(F.col("ret_d5")).alias("ret"), r6(F.col("net_d5")).alias("net"))


@query(f"WITH {_DAILY.replace('KEEP ', '')} {_RESULT}")
def daily_study(spark, d):
    """The daily event study with all its reasons in order."""
    return _daily(spark, d)


@query(f"WITH {_DAILY.replace('KEEP ', chr(10) + '  WHEN amount IS NULL THEN ' + chr(39) + 'no_amount' + chr(39) + ' WHEN user_id % 5 = 0 THEN ' + chr(39) + 'no_revenue' + chr(39) + ' WHEN amount / (user_id * 10) < 0.05 THEN ' + chr(39) + 'below_magnitude' + chr(39) + ' ')} {_RESULT}")
def magnitude_study(spark, d):
    """The same with a filter of its own: the amount over the revenue known then."""
    revenue = F.when(F.col("security_id") % 5 != 0, F.col("security_id") * 10.0)
    return _daily(spark, d, studies.size_filter(F.col("amount"), revenue, 0.05))


@query(f"""WITH {_MARKET},
hs AS (SELECT *, count(*) OVER m AS n, quantile_cont(t, 0.5) OVER m AS med FROM pr WINDOW m AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
dy AS (SELECT user_id, symbol, day, o / pc - 1 AS gap, CASE WHEN med < 100 THEN 0 WHEN med < 300 THEN 1 ELSE 2 END AS lq, CASE WHEN o / pc - 1 < 0.5 THEN 0 ELSE 1 END AS gb, 1 - c / nullif(o, 0) AS short,
  CASE WHEN NOT coalesce(o <> 0 AND c <> 0 AND pc <> 0 AND h <> 0 AND l <> 0, false) THEN 'no_price' WHEN EXISTS (SELECT 1 FROM ac WHERE ac.symbol = hs.symbol AND ac.day = hs.day) THEN 'ex_date' WHEN pc < 5 THEN 'low_price' WHEN n < 3 OR med < 20 THEN 'illiquid' WHEN h = l THEN 'locked' WHEN o / pc - 1 < 0.02 THEN 'no_gap_up' WHEN o / pc - 1 >= 8 THEN 'circuit_gap' WHEN user_id % 4 = 0 AND o / pc - 1 >= 0.3 - 0.01 THEN 'near_band' END AS dr FROM hs),
ev AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 12 <> 0 THEN CAST(ts + INTERVAL 330 MINUTE AS DATE) END AS day, event_id % 12 = 1 AS ins, event_id % 12 = 2 AS late, event_id % 12 = 3 AS nosym FROM events WHERE event_type = 'signup'),
e1 AS (SELECT ev.*, CASE WHEN day IS NULL THEN 'outside_window' WHEN ins THEN 'in_session' WHEN late THEN 'too_late' WHEN nosym THEN 'no_symbol' END AS r1 FROM ev),
e2 AS (SELECT e1.*, CASE WHEN dy.day IS NULL THEN 'no_price' ELSE dr END AS dr, short, lq, gb FROM e1 LEFT JOIN dy USING (user_id, day) WHERE r1 IS NULL),
tk AS (SELECT user_id, day, min((ts, event_id)) AS first FROM e2 WHERE dr IS NULL GROUP BY ALL), e3 AS (SELECT e2.*, CASE WHEN first IS NOT NULL AND (ts, event_id) > first THEN 'duplicate' ELSE dr END AS reason FROM e2 LEFT JOIN tk USING (user_id, day)),
ct AS (SELECT day, lq, gb, count(*) AS controls, avg(short) AS cg FROM dy WHERE dr IS NULL AND user_id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'signup' AND x.user_id = dy.user_id AND CAST(x.ts + INTERVAL 330 MINUTE AS DATE) = dy.day) GROUP BY ALL)
SELECT event_id, reason, floor(CASE WHEN reason IS NULL THEN short END * 1e6 + 0.5) / 1e6 AS short_gross, CASE WHEN reason IS NULL THEN controls END AS controls, floor(CASE WHEN reason IS NULL THEN short - cg END * 1e6 + 0.5) / 1e6 AS effect FROM e3 LEFT JOIN ct USING (day, lq, gb)
UNION ALL SELECT event_id, r1, NULL, NULL, NULL FROM e1 WHERE r1 IS NOT NULL""")
def gap_fade_study(spark, d):
    """The gap-fade study with all its reasons in order, and controls that filed nothing."""
    e, prices, names, actions, _ = _market(spark, d)
    bands = prices.select("symbol", F.when(F.col("user_id") % 4 == 0, 0.3).alias("band")).distinct()
    days = studies.gap_days(prices, actions, bands, lookback=3, least_turnover=20, least_price=5, gap_edges=[0.02, 0.5, 8.0], liquidity_edges=[0.0, 100.0, 300.0], band_margin=0.01)
    days = days.join(names.select("symbol", "security_id"), "symbol", "left")
    filed = e.where("event_type = 'signup'").select(F.col("user_id").alias("security_id"), "day")
    n = F.col("event_id") % 12
    symbol = F.concat(F.when(F.col("day") < F.lit("2024-01-16").cast("date"), "A").otherwise("B"), "user_id")
    events = e.where("event_type = 'signup'").select(F.col("event_id").alias("filing_id"), F.col("user_id").alias("security_id"), F.when(n != 3, symbol).alias("symbol"), F.when(n != 0, F.col("day")).alias("entry_day"), (n == 1).alias("in_session"), (n == 2).alias("too_late"), F.col("ts").alias("at"))
    found = studies.gap_fade(events, days, filed)
    return found.select(F.col("filing_id").alias("event_id"), "reason", r6(F.col("short_gross")).alias("short_gross"), "controls", r6(F.col("effect")).alias("effect"))
