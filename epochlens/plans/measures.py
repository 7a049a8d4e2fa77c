"""Queries: aggregations, windows, statistics, ledger and studies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.functions.scalars import bucket, exchange_date, ordered_sum, r6, size_agreement, tax_category, wilson
from epochlens.operators import calendar as cal_ops
from epochlens.operators import ledger, stats, windows
from epochlens.plans.reads import events_calendar
from epochlens.plans.registry import CALENDAR_SQL, micros, query, table
from epochlens.session import materialised

R = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("SELECT l_partkey, l_orderkey, l_linenumber, floor(m * 1e6 + 0.5) / 1e6 AS median FROM (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN count(*) OVER w >= 10 THEN quantile_cont(l_extendedprice, 0.5) OVER w END AS m FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))")
def rolling_median_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    out = windows.rolling_median_rows(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice", 10)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", r6(F.col("median")).alias("median"))


_TURNOVER = "v AS (SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, sum(value) AS turnover FROM events GROUP BY ALL)"


def _turnover(spark, d):
    return table(spark, d, "events").groupBy("user_id", exchange_date(F.col("ts")).alias("day")).agg(F.sum("value").alias("turnover"))


@query(f"""WITH {CALENDAR_SQL}, {_TURNOVER},
k AS (SELECT user_id, min(day) AS a, max(day) AS b FROM v GROUP BY 1),
g AS (SELECT k.user_id, c.day, c.session_no, coalesce(v.turnover, 0) AS t FROM k JOIN cal c ON c.session_no IS NOT NULL AND c.day BETWEEN k.a AND k.b LEFT JOIN v ON v.user_id = k.user_id AND v.day = c.day)
SELECT user_id, day::VARCHAR AS day, floor(m * 1e6 + 0.5) / 1e6 AS median FROM (SELECT user_id, day, CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(t, 0.5) OVER w END AS m FROM g WINDOW w AS (PARTITION BY user_id ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""")
def rolling_median_sessions(spark, d):
    sessions = events_calendar(spark, d).where("session_no is not null").select("day", "session_no")
    out = windows.rolling_median_sessions(_turnover(spark, d), sessions, ["user_id"], "day", "turnover", 5)
    return out.select("user_id", F.col("day").cast("string"), r6(F.col("median")).alias("median"))


@query("""
WITH RECURSIVE b AS (SELECT user_id, event_type, event_id, CAST(ts AS DATE) - DATE '2024-01-01' AS place, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, event_type, event_id, rn, place AS last, true AS kept FROM b WHERE rn = 1
  UNION ALL
  SELECT b.user_id, b.event_type, b.event_id, b.rn, CASE WHEN b.place - w.last > 3 THEN b.place ELSE w.last END, b.place - w.last > 3 FROM walk w JOIN b ON b.user_id = w.user_id AND b.event_type = w.event_type AND b.rn = w.rn + 1)
SELECT event_id, kept FROM walk""")
def cooldown_dedupe(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("place"))
    return windows.cooldown(e, ["user_id", "event_type"], ["ts", "event_id"], "place", 3).select("event_id", "kept")


_FACTORS = "f AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, 1 + l_discount AS m FROM lineitem WHERE l_discount >= 0.09), r AS (SELECT DISTINCT l_partkey AS k, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 365 AS b FROM lineitem WHERE l_linenumber = 1)"


def _factors(spark, d):
    li = table(spark, d, "lineitem")
    f = li.where("l_discount >= 0.09").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("day"), (1 + F.col("l_discount")).alias("m"))
    return f, li.where("l_linenumber = 1").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), 365).alias("b")).distinct()


@query(f"WITH {_FACTORS} SELECT r.k, r.a::VARCHAR AS a, floor(coalesce(product(f.m), 1) * 1e6 + 0.5) / 1e6 AS multiplier FROM r LEFT JOIN f ON f.k = r.k AND f.day > r.a AND f.day <= r.b GROUP BY r.k, r.a")
def cum_product_range(spark, d):
    f, rows = _factors(spark, d)
    return windows.product_between(rows, f, "k", "a", "b", "day", "m").select("k", F.col("a").cast("string"), r6(F.col("multiplier")).alias("multiplier"))


@query(f"WITH {_FACTORS} SELECT k, a::VARCHAR AS a, EXISTS (SELECT 1 FROM f WHERE f.k = r.k AND f.day BETWEEN r.a AND r.b) AS flagged FROM r")
def any_flag_range(spark, d):
    f, rows = _factors(spark, d)
    return windows.any_between(rows, f, "k", "a", "b", "day").select("k", F.col("a").cast("string"), "flagged")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_so_far FROM events")
def running_high(spark, d):
    e = table(spark, d, "events").withColumn("day", exchange_date(F.col("ts")))
    return windows.running_max_before(e, ["user_id", "day"], ["ts", "event_id"], "value").select("event_id", "high_so_far")


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, floor(sum(value) * 1e6 + 0.5) / 1e6 AS volume, count(*) AS ticks FROM events GROUP BY ALL")
def ohlcv_bars(spark, d):
    at = F.struct("ts", "event_id")
    out = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), r6(F.sum("value")).alias("volume"), F.count("*").alias("ticks"))
    return out.select("event_type", F.unix_micros("w.start").alias("start_us"), "open", "high", "low", "close", "volume", "ticks")


@query("SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE)::VARCHAR AS day, count(*) AS bars FROM events GROUP BY ALL")
def bars_per_day(spark, d):
    return table(spark, d, "events").groupBy("user_id", exchange_date(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("bars"))


@query("""
WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low, sum(value) AS volume FROM events GROUP BY ALL),
e AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (event_id % 20 <> 0) AS high, min(value) FILTER (event_id % 15 <> 0) AS low, sum(value) FILTER (event_id % 25 <> 0) AS volume FROM events GROUP BY ALL)
SELECT b.user_id, b.day::VARCHAR AS day, coalesce(abs(b.high - e.high) <= 0.005, false) AS high_ok, coalesce(abs(b.low - e.low) <= 0.005, false) AS low_ok, coalesce(abs(b.volume - e.volume) <= 0.02 * e.volume, false) AS volume_ok FROM b JOIN e USING (user_id, day)""")
def eod_check(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    g = e.groupBy("user_id", "day").agg(F.max("value").alias("h"), F.min("value").alias("l"), F.sum("value").alias("v"), F.max(F.when(F.col("event_id") % 20 != 0, F.col("value"))).alias("eh"), F.min(F.when(F.col("event_id") % 15 != 0, F.col("value"))).alias("el"), F.sum(F.when(F.col("event_id") % 25 != 0, F.col("value"))).alias("ev"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return g.select("user_id", F.col("day").cast("string"), ok(F.abs(F.col("h") - F.col("eh")) <= 0.005).alias("high_ok"), ok(F.abs(F.col("l") - F.col("el")) <= 0.005).alias("low_ok"), ok(F.abs(F.col("v") - F.col("ev")) <= 0.02 * F.col("ev")).alias("volume_ok"))


_EQUITY = "q AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day, 1e7 + sum(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END)) OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS equity FROM orders GROUP BY 1, 2)"


def _equity(spark, d):
    day = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("net"))
    return day.select("k", "day", (1e7 + F.sum("net").over(W.partitionBy("k").orderBy("day"))).alias("equity"))


@query(f"WITH {_EQUITY}, p AS (SELECT k, equity, max(equity) OVER (PARTITION BY k ORDER BY day) AS peak FROM q) SELECT k, floor(max(peak - equity) * 100 + 0.5) / 100 AS max_drawdown, floor(max((peak - equity) / peak) * 1e6 + 0.5) / 1e6 AS max_drawdown_share FROM p GROUP BY 1")
def drawdown(spark, d):
    out = windows.drawdown(_equity(spark, d), ["k"], ["day"], "equity")
    return out.select("k", (F.floor(F.col("max_drawdown") * 100 + 0.5) / 100).alias("max_drawdown"), r6(F.col("max_drawdown_share")).alias("max_drawdown_share"))


_SESSIONS = "s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM q), (SELECT max(day) FROM q), INTERVAL 1 DAY)) AS DATE) AS day)"
_RETURNS = f"{_EQUITY}, {_SESSIONS}, b AS (SELECT k, min(day) AS a, max(day) AS z FROM q GROUP BY 1), g AS (SELECT b.k, s.day, q.equity FROM b JOIN s ON isodow(s.day) <= 5 AND s.day BETWEEN b.a AND b.z LEFT JOIN q ON q.k = b.k AND q.day = s.day), f AS (SELECT k, day, last_value(equity IGNORE NULLS) OVER (PARTITION BY k ORDER BY day) AS equity FROM g), ret AS (SELECT k, day, equity, equity / lag(equity) OVER (PARTITION BY k ORDER BY day) - 1 AS ret FROM f)"


def _returns(spark, d):
    q = _equity(spark, d)
    span = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    sessions = span.select(F.explode(F.sequence("a", "b")).alias("day")).where("dayofweek(day) between 2 and 6")
    return windows.daily_returns(q, sessions, ["k"], "day", "equity")


@query(f"WITH {_RETURNS} SELECT k, day::VARCHAR AS day, floor(ret * 1e6 + 0.5) / 1e6 AS ret FROM ret")
def daily_returns_ffill(spark, d):
    return _returns(spark, d).select("k", F.col("day").cast("string"), r6(F.col("ret")).alias("ret"))


@query(f"WITH {_RETURNS} SELECT k, floor(avg(ret) / stddev_samp(ret) * sqrt(252) * 1e6 + 0.5) / 1e6 AS sharpe, floor(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) * 1e6 + 0.5) / 1e6 AS sortino FROM ret WHERE ret IS NOT NULL GROUP BY 1")
def sharpe_sortino(spark, d):
    return stats.sharpe(_returns(spark, d), ["k"], "ret").select("k", r6(F.col("sharpe")).alias("sharpe"), r6(F.col("sortino")).alias("sortino"))


_CLUSTERED = """
i AS (SELECT event_type, CAST(ts AS DATE) AS c, count(*) AS n, sum(value - 50) AS s, sum(CASE WHEN value - 50 > 0 THEN 1 ELSE 0 END) AS h FROM events GROUP BY ALL),
m AS (SELECT event_type, sum(n) AS n, count(*) AS g, sum(s) / sum(n) AS mean, sum(h) / sum(n) AS hit FROM i GROUP BY 1),
cm AS (SELECT m.event_type, m.n, m.g, m.mean, m.hit, sqrt(m.g / (m.g - 1) * sum(pow(i.s - i.n * m.mean, 2))) / m.n AS se FROM i JOIN m USING (event_type) GROUP BY m.event_type, m.n, m.g, m.mean, m.hit)"""


def _cells(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("c"), (F.col("value") - 50).alias("x"))
    return stats.clustered_mean(e, ["event_type"], "c", "x")


@query(f"WITH {_CLUSTERED} SELECT event_type, n::BIGINT AS n, g AS clusters, floor(mean * 1e6 + 0.5) / 1e6 AS mean, floor(hit * 1e6 + 0.5) / 1e6 AS hit_rate, floor(se * 1e6 + 0.5) / 1e6 AS se, floor(mean / se * 1e6 + 0.5) / 1e6 AS t FROM cm")
def clustered_mean(spark, d):
    return _cells(spark, d).select("event_type", "n", "clusters", *(r6(F.col(c)).alias(c) for c in ("mean", "hit_rate", "se", "t")))


@query("""
WITH p AS (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE avg(value) / 200 END AS p FROM events GROUP BY 1),
r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, user_id) AS k FROM p WHERE p IS NOT NULL)
SELECT user_id, floor(min(least(1, p * m / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 1e6 + 0.5) / 1e6 AS p_adjusted FROM r UNION ALL SELECT user_id, NULL FROM p WHERE p IS NULL""")
def bh_adjust(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 200).alias("p")).withColumn("p", F.when(F.col("user_id") % 13 != 0, F.col("p")))
    return stats.bh_adjust(p, [], "p", ["user_id"]).select("user_id", r6(F.col("p_adjusted")).alias("p_adjusted"))


#: SQL of one-sided p-values: the finite sum for whole degrees of freedom.
_P = """
pv AS (SELECT *, atan2(abs(mean / se), sqrt(g - 1)) AS th, g - 1 AS df, mean / se AS t FROM cm),
pw AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(th) * (1 + coalesce(list_sum(list_transform(range(2, df - 1, 2), lambda k: list_product(list_transform(range(2, k + 1, 2), lambda j: (j - 1) / j)) * pow(cos(th), k))), 0))
  ELSE 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * (1 + coalesce(list_sum(list_transform(range(3, df - 1, 2), lambda k: list_product(list_transform(range(3, k + 1, 2), lambda j: (j - 1) / j)) * pow(cos(th), k - 1))), 0)) ELSE 0 END) END AS within FROM pv),
pp AS (SELECT *, CASE WHEN t >= 0 THEN (1 - within) / 2 ELSE 1 - (1 - within) / 2 END AS p FROM pw)"""


def _draws_sql(clusters: str, resamples: int, seed: int) -> str:
    """SQL of the means of draws of a table ``clusters`` (event_type, c, n, s): bm (event_type, draw, mean)."""
    step = lambda u, n: f"(({u} * 48271 + {n} * 104729 + 7919) % 2147483647)"
    return f"""
bc AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c) - 1 AS i FROM {clusters}), bg AS (SELECT event_type, count(*) AS size, row_number() OVER (ORDER BY event_type) AS g FROM bc GROUP BY 1),
b0 AS (SELECT event_type, size, g, unnest(range(1, {resamples} + 1)) AS draw FROM bg), b1 AS (SELECT *, unnest(range(0, size)) AS j FROM b0),
b2 AS (SELECT *, {step(seed, 'g')} AS u FROM b1), b3 AS (SELECT *, (u * u + 12345) % 2147483647 AS v FROM b2), b4 AS (SELECT *, {step('v', 'draw')} AS w FROM b3), b5 AS (SELECT *, (w * w + 12345) % 2147483647 AS x FROM b4),
b6 AS (SELECT *, {step('x', 'j')} AS y FROM b5), b7 AS (SELECT *, (y * y + 12345) % 2147483647 AS z FROM b6), b8 AS (SELECT event_type, draw, ((z * z + 69621) % 2147483647) % size AS i FROM b7),
bm AS (SELECT event_type, draw, sum(s) / sum(n) AS mean FROM b8 JOIN bc USING (event_type, i) GROUP BY ALL)"""


@query(f"""WITH {_CLUSTERED}, {_P}, {_draws_sql('i', 300, 11)},
q0 AS (SELECT event_type, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, event_type) AS k FROM pp), q AS (SELECT event_type, m, min(least(1, p * m / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adjusted FROM q0),
lv AS (SELECT *, least(1.0, greatest(count(*) FILTER (adjusted <= 0.05) OVER (), 1) * 0.05 / m) AS level FROM q), rk AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean, draw) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM bm),
bd AS (SELECT event_type, min(mean) + (max(mean) - min(mean)) * (any_value(level * (n - 1)) - floor(any_value(level * (n - 1)))) AS bound FROM rk JOIN lv USING (event_type) WHERE k = floor(level * (n - 1)) OR k = ceil(level * (n - 1)) GROUP BY 1)
SELECT event_type, floor(bound * 1e6 + 0.5) / 1e6 AS fcr_lower, array_to_string(list_filter([CASE WHEN n < 100 THEN 'n' END, CASE WHEN NOT mean > 0 THEN 'mean' END, CASE WHEN NOT adjusted <= 0.05 THEN 'selection' END, CASE WHEN NOT bound > 0 THEN 'bound' END], lambda x: x IS NOT NULL), ',') AS reasons,
  n >= 100 AND mean > 0 AND adjusted <= 0.05 AND bound > 0 AS passed FROM cm JOIN lv USING (event_type) JOIN bd USING (event_type)""")
def gate_cells(spark, d):
    """The gate over a report's cells: enough rows, a positive mean, selected among its family, and a positive false-coverage bound."""
    return stats.gate(_report(spark, d), 100, 0.05).select("event_type", r6(F.col("fcr_lower")).alias("fcr_lower"), "reasons", "passed")


def _report(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("c"), (F.col("value") - 50).alias("x"))
    return stats.report_cells(e, ["event_type"], [], "c", "x", resamples=300, seed=11, q=0.05)


@query(f"""WITH {_CLUSTERED}, {_draws_sql('i', 300, 11)}
SELECT cm.event_type, n::BIGINT AS n, floor(cm.mean * 1e6 + 0.5) / 1e6 AS mean, floor(b.low * 1e6 + 0.5) / 1e6 AS low, floor(b.high * 1e6 + 0.5) / 1e6 AS high FROM cm JOIN (SELECT event_type, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM bm GROUP BY 1) b USING (event_type)""")
def report_cells(spark, d):
    return _report(spark, d).select("event_type", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "low", "high")))


@query("""
WITH k AS (SELECT toxic, count(*) AS n, sum(quality) AS k FROM labels GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM k)
SELECT toxic, n, k::BIGINT AS k,
  floor(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0) * 1e6 + 0.5) / 1e6 AS low,
  floor(least((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1) * 1e6 + 0.5) / 1e6 AS high FROM p""")
def wilson_interval(spark, d):
    g = table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("toxic", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


@query(f"""WITH k AS (SELECT event_type, CAST(ts AS DATE) AS c, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL), {_draws_sql('k', 500, 7)}
SELECT event_type, floor(quantile_cont(mean, 0.025) * 1e6 + 0.5) / 1e6 AS low, floor(quantile_cont(mean, 0.975) * 1e6 + 0.5) / 1e6 AS high FROM bm GROUP BY 1""")
def bootstrap_ci(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("c"), "value")
    return stats.bootstrap_interval(e, ["event_type"], "c", "value", 500, 7).select("event_type", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(f"WITH {_CLUSTERED}, {_P} SELECT event_type, floor(t * 1e6 + 0.5) / 1e6 AS t, floor(p * 1e9 + 0.5) / 1e9 AS p FROM pp")
def cell_p_values(spark, d):
    c = _cells(spark, d).withColumn("p", stats.t_tail(F.col("t"), (F.col("clusters") - 1).cast("double")))
    return c.select("event_type", r6(F.col("t")).alias("t"), (F.floor(F.col("p") * 1e9 + 0.5) / 1e9).alias("p"))


_FILLS = "x AS (SELECT l_suppkey AS k, l_shipdate AS d, l_orderkey AS o, l_linenumber AS l, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS id, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS q, l_extendedprice / l_quantity AS price FROM lineitem)"


def _fills(spark, d):
    li = table(spark, d, "lineitem")
    # ties of two lines are told apart by their price
    return li.select(F.col("l_suppkey").alias("k"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query("""
WITH x AS (SELECT l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS q, l_extendedprice / l_quantity AS price,
  sum(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag = 'R' ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem),
p AS (SELECT b.k, least(b.e, s.e) - greatest(b.e - b.q, s.e - s.q) AS q, b.price AS bp, s.price AS sp FROM x b JOIN x s ON b.k = s.k AND b.side = 'buy' AND s.side = 'sell' AND least(b.e, s.e) > greatest(b.e - b.q, s.e - s.q))
SELECT k, count(*) AS pieces, floor(sum(q) * 1e6 + 0.5) / 1e6 AS quantity, floor(sum((sp - bp) * q) * 100 + 0.5) / 100 AS pnl FROM p GROUP BY 1""")
def fifo_trades(spark, d):
    out = ledger.fifo_trades(_fills(spark, d), ["k"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], "side", "q", "price")
    return out.groupBy("k").agg(F.count("*").alias("pieces"), r6(F.sum("quantity")).alias("quantity"), (F.floor(F.sum("pnl") * 100 + 0.5) / 100).alias("pnl"))


@query("SELECT l_suppkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS open_quantity FROM lineitem GROUP BY 1")
def net_positions(spark, d):
    return ledger.net_positions(_fills(spark, d), ["k"], "side", "q")


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]


@query("""
WITH b AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS v, l_tax AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT l_suppkey AS k, sum(l_quantity) AS sold FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT *, least(q, e - coalesce(sold, 0)) AS open FROM b LEFT JOIN s USING (k))
SELECT k, l_orderkey, l_linenumber, open AS open_quantity, floor(v / q * 1e6 + 0.5) / 1e6 AS price, floor(c * open / q * 1e6 + 0.5) / 1e6 AS charges FROM o WHERE open > 0""")
def open_lots(spark, d):
    """What is left of each buy, with its price and its share of the charges."""
    fills = _fills(spark, d).join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.col("l_suppkey").alias("k"), F.col("l_tax").alias("c")).distinct(), ["k", *_ORDER])
    lots = ledger.open_lots(fills, ["k"], _ORDER, "side", "q", "price", "c")
    return lots.select("k", "buy_at.l_orderkey", "buy_at.l_linenumber", "open_quantity", r6(F.col("price")).alias("price"), r6(F.col("charges")).alias("charges"))


@query("""
WITH r AS (SELECT l_suppkey AS k, l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS held FROM lineitem)
SELECT k, -min(held) AS most FROM r WHERE held < 0 GROUP BY 1""")
def oversold_keys(spark, d):
    """Keys that at some moment sold more than they held."""
    return ledger.oversold(_fills(spark, d), ["k"], _ORDER, "side", "q").select("k", "most")


@query("""
WITH f AS (SELECT l_suppkey AS k, l_quantity AS q, l_extendedprice AS v, l_tax AS c, CASE WHEN l_returnflag = 'R' AND false THEN 'sell' ELSE 'buy' END AS side FROM lineitem)
SELECT k, floor(sum(-v - c) * 100 + 0.5) / 100 AS cash, 0.0 AS gap FROM f GROUP BY 1""")
def cash_reconciliation(spark, d):
    """Cash moved by fills against what closed trades and open lots say; each buy is followed by a sell of half of it and a later sell of the rest at the same price."""
    # dealt out by key first: lines, fills and what they leave held are made where the rows lie
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), *_ORDER, "l_quantity", "l_tax").repartition("k").groupBy("k", *_ORDER).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("v"), F.sum("l_tax").alias("c"))
    fills = li.select("k", *_ORDER, F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), (F.col("q") * part).alias("q"), F.try_divide("v", "q").alias("price"), (F.col("c") * cost).alias("c")) for side, n, part, cost in (("buy", 0, 1.0, 0.5), ("sell", 1, 0.5, 0.25), ("buy", 2, 0.5, 0.25))))).alias("x")).select("k", *_ORDER, "x.*")
    order = [*_ORDER, "n"]
    checked = materialised(ledger.covered(fills, ["k"], order, "side", "q"), "fills")  # it is asked three times
    trades = ledger.fifo_trades(checked, ["k"], order, "side", "q", "price", "c")
    found = ledger.cash_check(checked, trades, ledger.open_lots(checked, ["k"], order, "side", "q", "price", "c"), ["k"], "side", "q", "price", "c")
    fixed = lambda c: (F.floor(F.col(c) * 100 + 0.5) / 100).alias(c)
    return found.select("k", fixed("cash"), F.abs(fixed("gap")).alias("gap"))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS q FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS q FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.q, 0) AS ours, coalesce(b.q, 0) AS theirs FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE coalesce(a.q, 0) <> coalesce(b.q, 0)""")
def reconciliation(spark, d):
    o = table(spark, d, "orders")
    book = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("q"))
    return ledger.reconcile(book(o.where("o_orderstatus <> 'P'")), book(o.where("o_orderkey % 7 <> 0")), ["o_custkey"], "q")


@query("SELECT l_suppkey, floor(quantile_disc(0.1 * l_extendedprice / l_quantity, 0.25) * 1e6 + 0.5) / 1e6 AS capacity FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def capacity(spark, d):
    return ledger.capacity(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.1).select("l_suppkey", r6(F.col("capacity")).alias("capacity"))


_COSTS = """
f AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_linestatus = 'O' THEN 'delivery' ELSE 'intraday' END AS p, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS s, l_linenumber = 1 AS first FROM lineitem),
c AS (SELECT *, CASE WHEN p = 'delivery' THEN 20.0 ELSE least(20.0, v * 0.001) END AS brokerage,
  floor(v * CASE WHEN p = 'delivery' THEN 0.001 WHEN s = 'sell' THEN 0.00025 ELSE 0 END + 0.5) AS stt, v * 0.000030699 AS tx, v * 0.000000001 AS ipft, v * 0.000001 AS sebi,
  v * CASE WHEN s = 'sell' THEN 0 WHEN p = 'delivery' THEN 0.00015 ELSE 0.00003 END AS stamp, CASE WHEN p = 'delivery' AND s = 'sell' AND first THEN 20.0 ELSE 0 END AS dp FROM f),
t AS (SELECT *, 0.18 * (brokerage + tx + ipft + dp) AS gst FROM c)"""


@query(f"WITH {_COSTS} SELECT p AS product, s AS side, count(*) AS n, floor(sum(stt) * 100 + 0.5) / 100 AS stt, floor(sum(gst) * 1e4 + 0.5) / 1e4 AS gst, floor(sum(brokerage + stt + tx + ipft + sebi + stamp + dp + gst) * 1e4 + 0.5) / 1e4 AS total FROM t GROUP BY ALL")
def costs_charges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v"), F.when(F.col("l_linestatus") == "O", "delivery").otherwise("intraday").alias("product"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_linenumber") == 1).alias("first"))
    c = li.withColumn("c", ledger.charges(F.col("v"), F.col("product"), F.col("side"), F.col("first"), ledger.LATEST_RATES))
    fixed = lambda c, k: F.floor(F.sum(c) * k + 0.5) / k
    return c.groupBy("product", "side").agg(F.count("*").alias("n"), fixed("c.stt", 100).alias("stt"), fixed("c.gst", 1e4).alias("gst"), fixed("c.total", 1e4).alias("total"))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS b, l_discount AS x, l_returnflag = 'R' AS ev FROM lineitem),
c AS (SELECT l_shipdate, b, avg(x) AS cx, count(*) AS n FROM e WHERE NOT ev GROUP BY ALL)
SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, floor(e.x * 1e6 + 0.5) / 1e6 AS x, n AS controls, floor((e.x - cx) * 1e6 + 0.5) / 1e6 AS effect FROM e LEFT JOIN c USING (l_shipdate, b) WHERE ev""")
def matched_controls(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", bucket(F.col("l_quantity"), [10.0, 25.0]).alias("b"), F.col("l_discount").alias("x"), (F.col("l_returnflag") == "R").alias("ev"))
    controls = e.where("not ev").groupBy("l_shipdate", "b").agg(F.avg("x").alias("cx"), F.count("*").alias("controls"))
    return e.where("ev").join(controls, ["l_shipdate", "b"], "left").select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("x")).alias("x"), "controls", r6(F.col("x") - F.col("cx")).alias("effect"))


@query("SELECT CASE WHEN l_extendedprice < 1e4 THEN -1 WHEN l_extendedprice < 3e4 THEN 0 WHEN l_extendedprice < 6e4 THEN 1 ELSE 2 END AS bucket, count(*) AS n, floor(avg(l_discount) * 1e6 + 0.5) / 1e6 AS mean FROM lineitem GROUP BY 1")
def liquidity_buckets(spark, d):
    li = table(spark, d, "lineitem").withColumn("bucket", bucket(F.col("l_extendedprice"), [1e4, 3e4, 6e4]))
    return li.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("mean"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_disc(value, 0.5) AS d50, quantile_disc(value, 0.95) AS d95, max(value) AS worst FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("d50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("d95"), F.max("value").alias("worst"))
    return e


@query(f"WITH {CALENDAR_SQL}, {_TURNOVER} SELECT v.user_id, count(*) AS have, floor(count(*) / (SELECT count(*) FROM cal WHERE session_no IS NOT NULL) * 1e6 + 0.5) / 1e6 AS share, count(*) >= 0.98 * (SELECT count(*) FROM cal WHERE session_no IS NOT NULL) AS ready FROM v JOIN cal c ON c.day = v.day AND c.session_no IS NOT NULL GROUP BY 1")
def readiness_share(spark, d):
    cal = events_calendar(spark, d).where("session_no is not null").select("day")
    total = cal.agg(F.count("*").alias("total"))
    have = _turnover(spark, d).join(cal, "day", "left_semi").groupBy("user_id").agg(F.count("*").alias("have")).crossJoin(F.broadcast(total))  # one row
    return have.select("user_id", "have", r6(F.col("have") / F.col("total")).alias("share"), (F.col("have") >= 0.98 * F.col("total")).alias("ready"))


@query("SELECT event_type, CASE WHEN value > 90 THEN 'late' END AS reason, coalesce(CASE WHEN value > 90 THEN 'late' END, 'kept') AS outcome, count(*) AS n, count(DISTINCT user_id) AS users, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL")
def status_counts(spark, d):
    e = table(spark, d, "events").withColumn("reason", F.when(F.col("value") > 90, "late"))
    return e.groupBy("event_type", "reason", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(f"WITH {CALENDAR_SQL}, n AS (SELECT max(session_no) AS n FROM cal), s AS (SELECT n, unnest(generate_series(5 + 1 + 1, n - 3 + 1, 3)) AS t FROM n WHERE n >= 9) SELECT (row_number() OVER (ORDER BY t) - 1)::INTEGER AS split, (t - 6)::INTEGER AS train_from, (t - 2)::INTEGER AS train_to, t::INTEGER AS test_from, (t + 2)::INTEGER AS test_to FROM s")
def walk_forward_splits(spark, d):
    return windows.walk_forward(events_calendar(spark, d), train=5, test=3, embargo=1)


@query("""
WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT *, 100 * size / sum(size) OVER () AS q FROM s), r AS (SELECT *, floor(q) AS b, row_number() OVER (ORDER BY q - floor(q) DESC, lang) AS k, 100 - sum(floor(q)) OVER () AS rest FROM q)
SELECT lang, size, (b + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS draws FROM r""")
def stratified_allocation(spark, d):
    return windows.allocate(table(spark, d, "documents").select("lang"), "lang", 100)


@query()
def stratified_draw(spark, d):
    return windows.stratified_draw(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 100, 7)


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY user_id) // 5) AS step FROM events) SELECT user_id, event_id FROM n WHERE k % step = 0 AND k // step < 5")
def spaced_sample(spark, d):
    return windows.spaced_sample(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("SELECT l_returnflag, floor(regr_slope(l_extendedprice, l_quantity) * 1e4 + 0.5) / 1e4 AS slope, floor(corr(l_extendedprice, l_quantity) * 1e6 + 0.5) / 1e6 AS corr, floor(sum(l_discount * l_quantity) / sum(l_quantity) * 1e6 + 0.5) / 1e6 AS weighted, floor(avg(l_discount) * 1e6 + 0.5) / 1e6 AS equal FROM lineitem GROUP BY 1")
def regression_and_weights(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag")
    return li.agg((F.floor(F.regr_slope("l_extendedprice", "l_quantity") * 1e4 + 0.5) / 1e4).alias("slope"), r6(F.corr("l_extendedprice", "l_quantity")).alias("corr"), r6(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("weighted"), r6(F.avg("l_discount")).alias("equal"))


@query("""
WITH f AS (SELECT l_orderkey, floor(sum(l_extendedprice) / sum(l_quantity) * 1e6 + 0.5) / 1e6 AS price, min(l_extendedprice / l_quantity) AS decision FROM lineitem GROUP BY 1)
SELECT l_orderkey, price, floor((price / decision - 1) * 1e4 * 1e4 + 0.5) / 1e4 AS slippage_bp FROM f""")
def fill_slippage(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity"))).alias("price"), F.min(F.try_divide("l_extendedprice", "l_quantity")).alias("decision"))
    return f.select("l_orderkey", "price", (F.floor((F.try_divide("price", "decision") - 1) * 1e4 * 1e4 + 0.5) / 1e4).alias("slippage_bp"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'speculative' WHEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 800 AS INTEGER) > CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) THEN 'long_term' ELSE 'short_term' END AS category FROM orders")
def tax_categories(spark, d):
    o = table(spark, d, "orders").withColumn("opened", F.to_date("o_orderdate"))
    closed = F.date_add("opened", (F.col("o_custkey") % 800).cast("int"))
    return o.select("o_orderkey", tax_category(F.when(F.col("o_orderkey") % 3 == 0, "intraday").otherwise("delivery"), F.col("opened"), closed).alias("category"))


@query("SELECT doc_id, CASE WHEN abs(b / 1024.0 - s / 1024.0) <= 0.005 + 1 / 1024.0 THEN 'kb' WHEN abs(b / 1048576.0 - s / 1048576.0) <= 0.005 + 1 / 1048576.0 THEN 'mb' ELSE 'no' END AS agreement FROM (SELECT doc_id, n_chars AS b, n_chars + (doc_id % 5) * 2000 AS s FROM documents)")
def size_agreements(spark, d):
    return table(spark, d, "documents").select("doc_id", size_agreement(F.col("n_chars"), F.col("n_chars") + (F.col("doc_id") % 5) * 2000).alias("agreement"))


_PRICES = "px AS (SELECT user_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, avg(value) AS price FROM events GROUP BY ALL)"
_STUDY = f"""{CALENDAR_SQL}, {_PRICES},
en AS (SELECT e.event_id, e.event_type, e.user_id, o.day AS entry_day, o.session_no FROM events e ASOF LEFT JOIN (SELECT day, open_ts, session_no FROM cal WHERE session_no IS NOT NULL) o ON e.ts < o.open_ts),
st AS (SELECT en.event_id, en.event_type, en.entry_day, a.price AS entry, z.price AS exit,
  CASE WHEN en.entry_day IS NULL THEN 'outside_window' WHEN a.price IS NULL THEN 'no_entry_price' WHEN a.price < 10 THEN 'low_price' WHEN z.price IS NULL THEN 'no_exit_price' END AS reason
  FROM en LEFT JOIN px a ON a.user_id = en.user_id AND a.day = en.entry_day LEFT JOIN cal x ON x.session_no = en.session_no + 3 LEFT JOIN px z ON z.user_id = en.user_id AND z.day = x.day)"""


def _study(spark, d):
    """Every event with its entry session, its prices, its return, and the one reason why it doesn't count."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", "value")
    cal = events_calendar(spark, d)
    px = e.groupBy("user_id", exchange_date(F.col("ts")).alias("day")).agg((ordered_sum("value", "ts", "event_id") / F.count("value")).alias("price"))
    entered = cal_ops.shift_session(cal_ops.next_open(e.drop("value"), cal, "ts"), cal, "entry_day", 3, "exit_day")
    priced = entered.join(px.select("user_id", F.col("day").alias("entry_day"), F.col("price").alias("entry")), ["user_id", "entry_day"], "left")
    priced = priced.join(px.select("user_id", F.col("day").alias("exit_day"), F.col("price").alias("exit")), ["user_id", "exit_day"], "left")
    reason = F.when(F.col("entry_day").isNull(), "outside_window").when(F.col("entry").isNull(), "no_entry_price").when(F.col("entry") < 10, "low_price").when(F.col("exit").isNull(), "no_exit_price")
    return priced.withColumn("filter_reason", reason).withColumn("ret", F.when(reason.isNull(), F.try_divide("exit", "entry") - 1))


@query(f"WITH {_STUDY} SELECT event_id, entry_day::VARCHAR AS entry_day, reason AS filter_reason, floor(CASE WHEN reason IS NULL THEN exit / entry - 1 END * 1e6 + 0.5) / 1e6 AS ret FROM st")
def event_study_daily(spark, d):
    return _study(spark, d).select("event_id", F.col("entry_day").cast("string"), "filter_reason", r6(F.col("ret")).alias("ret"))


@query(f"""WITH {_STUDY}, x AS (SELECT event_type, entry_day AS c, exit / entry - 1 AS v FROM st WHERE reason IS NULL),
i AS (SELECT event_type, c, count(*) AS n, sum(v) AS s, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS h FROM x GROUP BY ALL), m AS (SELECT event_type, sum(n) AS n, count(*) AS g, sum(s) / sum(n) AS mean, sum(h) / sum(n) AS hit FROM i GROUP BY 1)
SELECT m.event_type, m.n::BIGINT AS n, m.g AS clusters, floor(m.mean * 1e6 + 0.5) / 1e6 AS mean, floor(m.hit * 1e6 + 0.5) / 1e6 AS hit_rate, floor(sqrt(m.g / (m.g - 1) * sum(pow(i.s - i.n * m.mean, 2))) / m.n * 1e6 + 0.5) / 1e6 AS se FROM i JOIN m USING (event_type) GROUP BY m.event_type, m.n, m.g, m.mean, m.hit""")
def event_study_mean(spark, d):
    out = stats.clustered_mean(_study(spark, d), ["event_type"], "entry_day", "ret")
    return out.select("event_type", "n", "clusters", *(r6(F.col(c)).alias(c) for c in ("mean", "hit_rate", "se")))


@query(f"WITH {_STUDY} SELECT event_type, coalesce(reason, 'kept') AS reason, count(*) AS n FROM st GROUP BY ALL")
def study_filter_counts(spark, d):
    return _study(spark, d).groupBy("event_type", F.coalesce("filter_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_id, user_id, ts + INTERVAL 25 SECOND AS decision FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, ts, value FROM events),
a AS (SELECT e.event_id, e.user_id, b.ts AS entry_ts, b.value AS entry FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.decision <= b.ts),
x AS (SELECT a.*, b.ts AS exit_ts, b.value AS exit FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.entry_ts + INTERVAL 6 HOUR <= b.ts)
SELECT event_id, epoch_us(entry_ts) AS entry_us, CASE WHEN entry_ts IS NULL THEN 'no_entry_bar' WHEN entry <= 0 THEN 'no_price' WHEN exit_ts IS NULL THEN 'no_exit_bar' END AS reason, floor(CASE WHEN entry > 0 THEN exit / entry - 1 END * 1e6 + 0.5) / 1e6 AS ret FROM x""")
def reaction_returns(spark, d):
    from epochlens.operators.asof import asof_join

    all_events = table(spark, d, "events")
    bars = all_events.groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    e = all_events.where("event_type = 'signup'").select("event_id", "user_id", (F.col("ts") + F.expr("interval 25 seconds")).alias("decision"))
    a = asof_join(e, bars.select("user_id", F.col("ts").alias("entry_ts"), F.col("value").alias("entry")), by=["user_id"], left_ts="decision", right_ts="entry_ts", take=["entry"], direction="forward").withColumn("due", F.col("entry_ts_matched") + F.expr("interval 6 hours"))
    live = asof_join(a.where("due is not null"), bars.select("user_id", F.col("ts").alias("exit_ts"), F.col("value").alias("exit")), by=["user_id"], left_ts="due", right_ts="exit_ts", take=["exit"], direction="forward")
    x = live.unionByName(a.where("due is null"), allowMissingColumns=True)
    reason = F.when(F.col("entry_ts_matched").isNull(), "no_entry_bar").when(F.col("entry") <= 0, "no_price").when(F.col("exit_ts_matched").isNull(), "no_exit_bar")
    return x.select("event_id", F.unix_micros("entry_ts_matched").alias("entry_us"), reason.alias("reason"), r6(F.when(F.col("entry") > 0, F.try_divide("exit", "entry") - 1)).alias("ret"))


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS c, sum(value) AS t, bool_or(event_type = 'signup') AS filed FROM events GROUP BY ALL),
h AS (SELECT *, lag(c) OVER w AS pc, count(*) OVER m AS n, quantile_cont(t, 0.5) OVER m AS med FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day), m AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN n < 5 THEN 'no_history' WHEN pc IS NULL OR pc <= 0 OR o <= 0 THEN 'no_price' WHEN med < 50 THEN 'illiquid' WHEN o / pc - 1 < 0.01 THEN 'no_gap' END AS reason, CASE WHEN med < 100 THEN 0 WHEN med < 200 THEN 1 ELSE 2 END AS b, CASE WHEN o / pc - 1 < 0.5 THEN 0 ELSE 1 END AS g, 1 - c / nullif(o, 0) AS short FROM h),
ct AS (SELECT day, b, g, avg(short) AS cs, count(*) AS controls FROM k WHERE reason IS NULL AND NOT filed GROUP BY ALL)
SELECT k.user_id, k.day::VARCHAR AS day, floor(short * 1e6 + 0.5) / 1e6 AS short_gross, controls, floor((short - cs) * 1e6 + 0.5) / 1e6 AS effect FROM k LEFT JOIN ct USING (day, b, g) WHERE filed AND reason IS NULL""")
def gap_fade_effect(spark, d):
    at = F.struct("ts", "event_id")
    p = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("value", at).alias("o"), F.max_by("value", at).alias("c"), ordered_sum("value", "ts", "event_id").alias("t"), F.bool_or(F.col("event_type") == "signup").alias("filed"))
    h = windows.rolling_median_rows(p, ["user_id"], ["day"], "t", 5, "med").withColumn("pc", F.lag("c").over(W.partitionBy("user_id").orderBy("day")))
    gap = F.try_divide("o", "pc") - 1
    bad_price = F.col("pc").isNull() | (F.col("pc") <= 0) | (F.col("o") <= 0)
    reason = F.when(F.col("med").isNull(), "no_history").when(bad_price, "no_price").when(F.col("med") < 50, "illiquid").when(gap < 0.01, "no_gap")
    k = h.where(reason.isNull()).select("user_id", "day", "filed", bucket(F.col("med"), [0.0, 100.0, 200.0]).alias("b"), F.when(gap < 0.5, 0).otherwise(1).alias("g"), (1 - F.try_divide("c", "o")).alias("short"))
    controls = k.where("not filed").groupBy("day", "b", "g").agg(F.avg("short").alias("cs"), F.count("*").alias("controls"))
    return k.where("filed").join(controls, ["day", "b", "g"], "left").select("user_id", F.col("day").cast("string"), r6(F.col("short")).alias("short_gross"), "controls", r6(F.col("short") - F.col("cs")).alias("effect"))


@query("""
WITH t AS (SELECT l_suppkey, l_extendedprice * (l_discount - 0.05) AS net, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS back FROM lineitem),
r AS (SELECT *, sum(net) OVER (PARTITION BY l_suppkey ORDER BY back DESC ROWS UNBOUNDED PRECEDING) AS total FROM t WHERE back <= 60)
SELECT l_suppkey, count(*) AS trades, floor(CASE WHEN count(*) >= 60 THEN avg(net) END * 100 + 0.5) / 100 AS expectancy, floor(min(total) * 100 + 0.5) / 100 AS lowest FROM r GROUP BY 1""")
def recent_expectancy(spark, d):
    """What each key's last sixty trades earned on the average, and how low they had run."""
    li = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    found = stats.recent_expectancy(li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], "net", 60)
    fixed = lambda c: (F.floor(F.col(c) * 100 + 0.5) / 100).alias(c)
    return found.select("l_suppkey", "trades", fixed("expectancy"), fixed("lowest"))


@query("""
SELECT event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50) UNION SELECT arg_min(event_id, (ts, event_id)) FROM events GROUP BY event_type UNION SELECT arg_min(event_id, (ts, event_id)) FROM events GROUP BY user_id""")
def cover_sample(spark, d):
    """The first fifty rows, and the first one of every type and user."""
    return windows.cover_sample(table(spark, d, "events").select("event_id", "ts", "event_type", "user_id"), ["ts", "event_id"], 50, ["event_type", "user_id"]).select("event_id")
