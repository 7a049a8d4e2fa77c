"""Queries: the intraday reaction with its placebo, and what ordinary days give."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.functions.scalars import exchange_date, r6
from epochlens.operators import reaction
from epochlens.plans.reads import events_calendar
from epochlens.plans.registry import CALENDAR_SQL, query, table
from epochlens.plans.studies import _MARKET, _market

_R = "floor(({}) * 1e6 + 0.5) / 1e6"

#: Every seventh event is a filing on the instrument that its type names; bars are hourly; decisions come 25 seconds later.
_REACTION = f"""{CALENDAR_SQL}, ss AS (SELECT day, session_no AS n, open_ts, close_ts FROM cal WHERE session_no IS NOT NULL),
bb AS (SELECT event_type AS inst, date_trunc('hour', ts) AS hr, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c FROM events GROUP BY event_type, date_trunc('hour', ts)),
bd AS (SELECT *, CAST(hr + INTERVAL 330 MINUTE AS DATE) AS day, max(h) OVER (PARTITION BY inst, CAST(hr + INTERVAL 330 MINUTE AS DATE) ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hs FROM bb),
ix AS (SELECT date_trunc('hour', ts) AS hr, CAST(date_trunc('hour', ts) + INTERVAL 330 MINUTE AS DATE) AS day, avg(value) AS o, avg(value) + 1 AS c FROM events GROUP BY date_trunc('hour', ts)),
d0 AS (SELECT event_id, event_type AS inst, ts + INTERVAL 25 SECOND AS t, CAST(ts + INTERVAL 25 SECOND + INTERVAL 330 MINUTE AS DATE) AS day FROM events WHERE event_id % 7 = 0),
d1 AS (SELECT d0.*, s.open_ts, coalesce(s.open_ts <= t AND t < s.close_ts AND strftime(t + INTERVAL 330 MINUTE, '%H:%M') < '14:30', false) AS ins FROM d0 LEFT JOIN ss s ON s.day = d0.day),
d2 AS (SELECT d1.event_id, d1.inst, d1.ins, CASE WHEN ins THEN t WHEN t < d1.open_ts THEN d1.open_ts ELSE x.open_ts END AS start FROM d1 ASOF LEFT JOIN ss x ON d1.day < x.day),
d3 AS (SELECT *, CAST(start + INTERVAL 330 MINUTE AS DATE) AS eday FROM d2),
d4 AS (SELECT d3.*, b.hr AS ets, b.o AS entry, b.h = b.l AND b.h >= coalesce(b.hs, b.h) AS locked FROM d3 ASOF LEFT JOIN bd b ON d3.inst = b.inst AND d3.eday = b.day AND d3.start <= b.hr),
d5 AS (SELECT d4.*, i.o AS io FROM d4 ASOF LEFT JOIN ix i ON d4.eday = i.day AND d4.ets <= i.hr),
d6 AS (SELECT *, CASE WHEN start IS NULL THEN 'outside_calendar' WHEN ets IS NULL OR ets >= start + INTERVAL 90 MINUTE OR strftime(ets + INTERVAL 330 MINUTE, '%H:%M') >= '14:30' THEN 'no_bar' WHEN locked THEN 'locked_entry' WHEN io IS NULL THEN 'no_benchmark' END AS reason FROM d5),
p0 AS (SELECT d6.event_id, d6.inst, p.day AS eday, d6.ets - to_days((d6.eday - p.day)::INTEGER) AS start FROM d6 ASOF JOIN ss p ON d6.eday > p.day WHERE reason IS NULL AND ins),
p1 AS (SELECT p0.*, b.hr AS ets, b.o AS entry FROM p0 ASOF JOIN bd b ON p0.inst = b.inst AND p0.eday = b.day AND p0.start <= b.hr),
p2 AS (SELECT p1.*, i.o AS io FROM p1 ASOF JOIN ix i ON p1.eday = i.day AND p1.ets <= i.hr WHERE p1.ets < p1.start + INTERVAL 90 MINUTE),
un AS (SELECT 'event' AS kind, event_id, inst, eday, ets, entry, io FROM d6 WHERE reason IS NULL UNION ALL SELECT 'placebo', event_id, inst, eday, ets, entry, io FROM p2),
wn AS (SELECT un.*, x.day AS nday FROM un ASOF LEFT JOIN ss x ON un.eday < x.day),
hz AS (SELECT * FROM (VALUES ('m60', 60), ('m120', 120), ('close', -1), ('next', -2)) v(ex, m)),
tg AS (SELECT wn.*, ex, m, CASE WHEN m > 0 THEN ets + to_minutes(m) ELSE CAST(eday AS TIMESTAMP) + INTERVAL 585 MINUTE END AS target FROM wn, hz),
x1 AS (SELECT tg.*, b.o AS xo FROM (SELECT * FROM tg WHERE m > -2 AND target <= CAST(eday AS TIMESTAMP) + INTERVAL 585 MINUTE) tg ASOF LEFT JOIN bd b ON tg.inst = b.inst AND tg.eday = b.day AND tg.target <= b.hr),
x2 AS (SELECT x1.*, i.o AS xi FROM x1 ASOF LEFT JOIN ix i ON x1.eday = i.day AND x1.target <= i.hr),
x3 AS (SELECT kind, event_id, ex, m, entry, io, xo, xi FROM x2 UNION ALL SELECT kind, event_id, ex, m, entry, io, lb.c, li.c FROM (SELECT * FROM tg WHERE m = -2) tg
  LEFT JOIN (SELECT inst, day, arg_max(c, hr) AS c FROM bd GROUP BY ALL) lb ON lb.inst = tg.inst AND lb.day = tg.nday LEFT JOIN (SELECT day, arg_max(c, hr) AS c FROM ix GROUP BY 1) li ON li.day = tg.nday),
rt AS (SELECT kind, event_id, ex, m, xo / nullif(entry, 0) - 1 AS gross, xo / nullif(entry, 0) - 1 - (xi / nullif(io, 0) - 1) AS abnormal FROM x3)
SELECT d6.event_id, hz.ex AS exit, CASE WHEN start IS NULL THEN NULL WHEN ins THEN 'session' ELSE 'overnight' END AS stratum, d6.reason, CASE WHEN reason IS NULL OR reason <> 'no_bar' THEN epoch_us(ets) END AS entry_us,
  {_R.format("CASE WHEN r.abnormal IS NOT NULL THEN r.gross END")} AS gross, {_R.format("r.abnormal")} AS abnormal, {_R.format("r.abnormal - CASE WHEN hz.m = -2 THEN 0.002 ELSE 0.001 END - 0.001")} AS net_base, {_R.format("r.abnormal - CASE WHEN hz.m = -2 THEN 0.002 ELSE 0.001 END - 0.004")} AS net_wide, {_R.format("p.abnormal")} AS placebo
FROM d6 CROSS JOIN hz LEFT JOIN rt r ON r.kind = 'event' AND r.event_id = d6.event_id AND r.ex = hz.ex LEFT JOIN rt p ON p.kind = 'placebo' AND p.event_id = d6.event_id AND p.ex = hz.ex AND r.event_id IS NOT NULL"""


@query(f"WITH {_REACTION}")
def reaction_study(spark, d):
    """Entry, four exits, two cost scenarios and the placebo of the session before, of every filing with its reason."""
    e = table(spark, d, "events")
    at, hour = F.struct("ts", "event_id"), F.date_trunc("hour", "ts")
    bars = e.groupBy(F.col("event_type").alias("instrument"), hour.alias("hr")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close")).withColumnRenamed("hr", "ts")
    index = e.groupBy(hour.alias("hr")).agg(F.avg("value").alias("open"), (F.avg("value") + 1).alias("close")).withColumnRenamed("hr", "ts")
    filings = e.where("event_id % 7 = 0").select("event_id", F.col("event_type").alias("instrument"), F.col("ts").alias("available_at"))
    found = reaction.react(
        filings, bars, index, events_calendar(spark, d), delay_s=25, cutoff="14:30", square_off="15:15", most_wait_min=90, exits={"m60": 60, "m120": 120, "close": reaction.SQUARE_OFF, "next": reaction.NEXT_CLOSE}, slippage_bps={"base": 5.0, "wide": 20.0},
        cost=lambda entry, out, overnight, bps: F.when(overnight, 0.002).otherwise(0.001) + 2 * bps / 1e4,
    )
    return found.select("event_id", "exit", "stratum", "reason", "entry_us", *(r6(F.col(c)).alias(c) for c in ("gross", "abnormal", "net_base", "net_wide", "placebo")))


_ORDINARY = f"""{CALENDAR_SQL}, {_MARKET},
ss AS (SELECT day, session_no AS n FROM cal WHERE session_no IS NOT NULL), bn AS (SELECT ss.day, n, avg(value) AS bo, avg(value) + 1 AS bc FROM events JOIN ss ON ss.day = CAST(ts + INTERVAL 330 MINUTE AS DATE) GROUP BY ss.day, n),
hs AS (SELECT *, count(*) OVER w AS k, quantile_cont(t, 0.5) OVER w AS med FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
od AS (SELECT hs.symbol, hs.user_id, hs.day, bn.n, o, bo FROM hs JOIN bn USING (day) WHERE k >= 3 AND o <> 0 AND pc <> 0 AND h <> 0 AND l <> 0 AND med >= 20 AND pc >= 5 AND h <> l AND abs(o / nullif(pc, 0) - 1) < 3 AND bo <> 0 AND bc <> 0),
rl AS (SELECT od.*, hz.k AS ahead, CASE WHEN hz.k = 0 OR abs(nullif(p.c, 0) / od.o - 1) <= 2 THEN nullif(p.c, 0) / od.o - 1 - (x.bc / od.bo - 1) END AS rel FROM od CROSS JOIN (VALUES (0), (1), (3)) hz(k) LEFT JOIN bn x ON x.n = od.n + hz.k AND x.bo <> 0 AND x.bc <> 0 LEFT JOIN pr p ON p.symbol = od.symbol AND p.day = x.day)"""


@query(f"""WITH {_ORDINARY}
SELECT CASE WHEN day < DATE '2024-01-16' THEN 'train' ELSE 'test' END AS period, ahead, count(rel) AS days, {_R.format("avg(rel)")} AS mean, {_R.format("quantile_cont(rel, 0.5)")} AS median, {_R.format("avg(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END)")} AS positive FROM rl WHERE rel IS NOT NULL GROUP BY ALL""")
def ordinary_days(spark, d):
    """Ordinary stock-days bought at the open, against the index, over three horizons in two periods."""
    found = _ordinary(spark, d)
    long = found.select("day", F.explode(F.array(*(F.struct(F.lit(k).alias("ahead"), F.col(f"rel_{k}").alias("rel")) for k in (0, 1, 3)))).alias("x")).select("day", "x.*").where("rel is not null")
    period = F.when(F.col("day") < F.lit("2024-01-16").cast("date"), "train").otherwise("test")
    return long.groupBy(period.alias("period"), "ahead").agg(F.count("*").alias("days"), r6(F.avg("rel")).alias("mean"), r6(F.percentile("rel", F.lit(0.5))).alias("median"), r6(F.avg((F.col("rel") > 0).cast("double"))).alias("positive"))


def _ordinary(spark, d):
    _, prices, _, _, bench = _market(spark, d)
    sessions = events_calendar(spark, d).where("session_no is not null").select("day", "session_no")
    return reaction.ordinary_days(prices.drop("user_id"), bench, sessions, lookback=3, least_turnover=20, least_price=5, most_gap=3, ahead={"0": 0, "1": 1, "3": 3}, most_move=2)


@query(f"""WITH {_ORDINARY},
fl AS (SELECT DISTINCT CASE WHEN ss.day < DATE '2024-01-16' THEN 'A' ELSE 'B' END || user_id AS symbol, n FROM events JOIN ss ON ss.day = CAST(ts + INTERVAL 330 MINUTE AS DATE) WHERE event_type = 'signup'),
fr AS (SELECT * FROM od WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.symbol = od.symbol AND abs(fl.n - od.n) < 2)),
nb AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m, row_number() OVER (PARTITION BY symbol ORDER BY n) - 1 AS p, (user_id * 7 + 11) AS off FROM fr),
dr AS (SELECT symbol, day FROM nb WHERE m <= 2 OR ((p + 1) * 2 + off % m) // m > (p * 2 + off % m) // m)
SELECT dr.symbol, dr.day::VARCHAR AS day, {_R.format("rl.rel")} AS rel FROM dr LEFT JOIN rl ON rl.symbol = dr.symbol AND rl.day = dr.day AND rl.ahead = 1""")
def placebo_days(spark, d):
    """Two ordinary days of each stock, evenly apart and two sessions or more from any filing of its own."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    day = exchange_date(F.col("ts"))
    sessions = events_calendar(spark, d).where("session_no is not null").select("day", "session_no")
    filed = e.select(F.concat(F.when(day < F.lit("2024-01-16").cast("date"), "A").otherwise("B"), "user_id").alias("symbol"), day.alias("day")).join(F.broadcast(sessions), "day").select("symbol", "session_no")
    far = reaction.away_from(_ordinary(spark, d), filed, by=["symbol"], place="session_no", least=2)
    user = F.regexp_extract("symbol", r"(\d+)$", 1).cast("long")
    drawn = reaction.evenly(far, by=["symbol"], place="session_no", n=2, offset=user * 7 + 11)
    return drawn.select("symbol", F.col("day").cast("string"), r6(F.col("rel_1")).alias("rel"))
