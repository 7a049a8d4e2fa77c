"""Intraday reaction to filings: entry at the first bar after what is known plus a measured delay, several exits and costs, and what ordinary days give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.functions.scalars import IST, exchange_date, exchange_instant
from epochlens.operators.asof import asof_join
from epochlens.operators.studies import first_of
from epochlens.session import materialised

#: Exits besides a number of minutes after the entry.
SQUARE_OFF, NEXT_CLOSE = "square_off", "next_close"


def _clock(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, IST), "HH:mm")


def _sessions(cal: DataFrame) -> DataFrame:
    """A row for each day of the calendar: its session's hours, and the next and previous regular sessions (next_open: that of the first one after it)."""
    day, regular = F.col("day"), F.col("session_no").isNotNull()
    line = W.partitionBy(F.lit(0)).orderBy("day")  # some thousands of days
    after, before = line.rowsBetween(1, W.unboundedFollowing), line.rowsBetween(W.unboundedPreceding, -1)
    following = F.first(F.when(regular, F.struct("day", "open_ts")), ignorenulls=True).over(after)
    return cal.select(day.alias("_day"), F.when(regular, F.col("open_ts")).alias("_open"), F.when(regular, F.col("close_ts")).alias("_close"), following["day"].alias("_next"), following["open_ts"].alias("_next_open"), F.last(F.when(regular, day), ignorenulls=True).over(before).alias("_previous"))


def earliest_tradable(events: DataFrame, cal: DataFrame, *, at: str, cutoff: str) -> DataFrame:
    """events with earliest, stratum (session, or overnight: the next session's open) and the session before and after its day; null off the calendar."""
    days = F.broadcast(_sessions(cal))  # some thousands of days
    rows = events.withColumn("_day", exchange_date(F.col(at))).join(days, "_day", "left")
    inside = F.coalesce((F.col("_open") <= F.col(at)) & (F.col(at) < F.col("_close")) & (_clock(F.col(at)) < cutoff), F.lit(False))
    # before the day's own open the next session is the day itself
    early = F.coalesce(F.col(at) < F.col("_open"), F.lit(False))
    earliest = F.when(inside, F.col(at)).when(early, F.col("_open")).otherwise(F.col("_next_open"))
    rows = rows.select(*events.columns, earliest.alias("earliest"), F.when(earliest.isNotNull(), F.when(inside, "session").otherwise("overnight")).alias("stratum"))
    rows = rows.withColumn("entry_day", exchange_date(F.col("earliest"))).join(days.select(F.col("_day").alias("entry_day"), F.col("_previous").alias("previous_day"), F.col("_next").alias("next_day")), "entry_day", "left")
    return rows.select(*events.columns, "earliest", "stratum", "entry_day", "previous_day", "next_day")


def _entered(rows: DataFrame, bars: DataFrame, index: DataFrame, at: str, day: str) -> DataFrame:
    """rows with the first bar of their instrument at or after an instant of that day (_b) and the index's open then (_io)."""
    rows = asof_join(rows, bars, by=["instrument", day], left_ts=at, right_ts="ts", take=["_b"], direction="forward").withColumnRenamed("ts_matched", "_ts")
    met = asof_join(rows.where("_ts is not null"), index, by=[day], left_ts="_ts", right_ts="its", take=["_io"], direction="forward").drop("its_matched")
    return met.unionByName(rows.where("_ts is null"), allowMissingColumns=True)


def react(
    events: DataFrame, bars: DataFrame, index: DataFrame, cal: DataFrame, *, delay_s: float, cutoff: str, square_off: str, most_wait_min: int, exits: dict[str, int | str], slippage_bps: dict[str, float], cost: Callable[[Column, Column, Column, float], Column], skip_locked: bool = True
) -> DataFrame:
    """A row for each event and exit: event_id, exit, stratum, reason, entry_us, entry, gross, abnormal, net_ of each scenario, and placebo.

    events: event_id, instrument, available_at. bars: instrument, ts, open, high, low, close; index: ts, open, close. exits: minutes after the entry, SQUARE_OFF or NEXT_CLOSE. cost(entry, exit, overnight, bps) is
    what a round trip costs as a share of what was bought. Reasons: outside_calendar, no_bar (none of the day within the wait and before the cutoff), locked_entry (flat at the day's high so far), no_benchmark.
    An exit after the square-off, or without bars, has no returns. placebo: the abnormal return of the same stock one session earlier at the entry's clock time, for entries within a session.
    All entries, placebos and exits are found by sweeps along each instrument's day; no pairs are made.
    """
    day = exchange_date(F.col("ts"))
    so_far = F.max("high").over(W.partitionBy("instrument", "_d").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    b = bars.withColumn("_d", day).withColumn("_h", so_far)
    locked = (F.col("high") == F.col("low")) & (F.col("high") >= F.coalesce("_h", "high"))
    b = materialised(b.select("instrument", F.col("_d").alias("entry_day"), "ts", F.struct(F.col("open").alias("open"), F.col("close").alias("close"), locked.alias("locked")).alias("_b")), "bars")
    i = materialised(index.select(day.alias("entry_day"), F.col("ts").alias("its"), F.col("open").alias("_io"), F.col("close").alias("_ic")), "index")
    idx = i.drop("_ic")
    decided = events.select("event_id", "instrument", (F.col("available_at") + F.make_dt_interval(secs=F.lit(delay_s))).alias("decided"))
    started = earliest_tradable(decided, cal, at="decided", cutoff=cutoff)
    real = _entered(started.where("earliest is not null"), b, idx, "earliest", "entry_day")
    wait = F.make_dt_interval(mins=F.lit(most_wait_min))
    late = F.col("_ts").isNull() | (F.col("_ts") >= F.col("earliest") + wait) | (_clock(F.col("_ts")) >= cutoff)
    reason = first_of(("no_bar", late), ("locked_entry", F.lit(skip_locked) & F.col("_b.locked")), ("no_benchmark", F.col("_io").isNull()))
    real = materialised(real.withColumn("reason", reason).withColumn("_kind", F.lit("event")), "entries")
    # the same clock time one session earlier
    clock = F.col("_ts") - (exchange_instant(F.col("entry_day"), "00:00") - exchange_instant(F.col("previous_day"), "00:00"))
    before = real.where("reason is null and stratum = 'session' and previous_day is not null").select("event_id", "instrument", "stratum", clock.alias("earliest"), F.col("previous_day").alias("entry_day"), F.col("entry_day").alias("next_day"))
    placebo = _entered(before, b, idx, "earliest", "entry_day")
    placebo = placebo.where(F.col("_ts").isNotNull() & F.col("_io").isNotNull() & (F.col("_ts") < F.col("earliest") + wait)).withColumn("_kind", F.lit("placebo"))
    shape = ["event_id", "instrument", "_kind", "entry_day", "next_day", "_ts", "_b", "_io"]
    both = real.where("reason is null").select(shape).unionByName(placebo.select(shape))
    closing = exchange_instant(F.col("entry_day"), square_off)
    targets = F.array(*(F.struct(F.lit(n).alias("exit"), (F.lit(None).cast("timestamp") if x == NEXT_CLOSE else closing if x == SQUARE_OFF else F.col("_ts") + F.make_dt_interval(mins=F.lit(int(x)))).alias("target"), F.lit(x == NEXT_CLOSE).alias("overnight")) for n, x in exits.items()))
    asked = both.withColumn("_e", F.explode(targets)).select(*shape, "_e.*").withColumnRenamed("_ts", "_entry_ts").withColumnRenamed("_b", "_eb").withColumnRenamed("_io", "_eio")
    within = asked.where(F.col("overnight") == F.lit(False)).where(F.col("target") <= closing)
    stock = asof_join(within, b, by=["instrument", "entry_day"], left_ts="target", right_ts="ts", take=["_b"], direction="forward").drop("ts_matched")
    out = asof_join(stock, idx, by=["entry_day"], left_ts="target", right_ts="its", take=["_io"], direction="forward").drop("its_matched").select("event_id", "_kind", "exit", "overnight", F.col("_eb.open").alias("entry"), "_eio", F.col("_b.open").alias("out"), F.col("_io").alias("_xio"))
    last_stock = b.groupBy("instrument", F.col("entry_day").alias("next_day")).agg(F.max_by("_b.close", "ts").alias("out"))
    last_index = i.groupBy(F.col("entry_day").alias("next_day")).agg(F.max_by("_ic", "its").alias("_xio"))
    nights = asked.where("overnight").join(last_stock, ["instrument", "next_day"], "left").join(F.broadcast(last_index), "next_day", "left")  # a row for each day
    out = out.unionByName(nights.select("event_id", "_kind", "exit", "overnight", F.col("_eb.open").alias("entry"), "_eio", "out", "_xio"))
    gross = F.try_divide("out", "entry") - 1
    abnormal = gross - (F.try_divide("_xio", "_eio") - 1)
    measured = out.withColumn("gross", F.when(abnormal.isNotNull(), gross)).withColumn("abnormal", abnormal)
    own = measured.where("_kind = 'event'").select("event_id", "exit", "gross", "abnormal", *((F.col("abnormal") - cost(F.col("entry"), F.col("out"), F.col("overnight"), bps)).alias(f"net_{label}") for label, bps in slippage_bps.items()))
    others = measured.where("_kind = 'placebo'").select("event_id", "exit", F.col("abnormal").alias("placebo"))
    returns = own.join(others, ["event_id", "exit"], "left")
    names = F.explode(F.array(*map(F.lit, exits))).alias("exit")
    rows = real.select("event_id", "stratum", "reason", F.unix_micros("_ts").alias("entry_us"), F.col("_b.open").alias("entry"), names).unionByName(started.where("earliest is null").select("event_id", "stratum", F.lit("outside_calendar").alias("reason"), names), allowMissingColumns=True)
    kept = lambda c: F.when(F.coalesce(F.col("reason") != "no_bar", F.lit(True)), F.col(c)).alias(c)
    return rows.select("event_id", "exit", "stratum", "reason", kept("entry_us"), kept("entry")).join(returns, ["event_id", "exit"], "left")


def away_from(days: DataFrame, filed: DataFrame, *, by: list[str], place: str, least: int) -> DataFrame:
    """Those of a key's days that are least places or more from any of its filings: one sweep along the key's places, with the last filing before and the first one after."""
    both = days.withColumn("_f", F.lit(None).cast("long")).unionByName(filed.select(*by, F.col(place), F.col(place).cast("long").alias("_f")).distinct(), allowMissingColumns=True)
    line = W.partitionBy(*by).orderBy(place)
    last, following = F.max("_f").over(line.rangeBetween(W.unboundedPreceding, 0)), F.min("_f").over(line.rangeBetween(0, W.unboundedFollowing))
    swept = both.withColumn("_last", last).withColumn("_next", following).where("_f is null")
    far = lambda x: F.coalesce(F.abs(F.col(place) - x) >= least, F.lit(True))
    return swept.where(far(F.col("_last")) & far(F.col("_next"))).select(*days.columns)


def evenly(days: DataFrame, *, by: list[str], place: str, n: int, offset: Column) -> DataFrame:
    """n of each key's days (all, if it has fewer), evenly apart; offset, taken modulo how many there are, says where the first gap begins."""
    w = W.partitionBy(*by)
    counted = days.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_p", F.row_number().over(w.orderBy(place)) - 1)
    at = lambda p: F.floor((p * n + F.pmod(offset, F.col("_n"))) / F.col("_n"))
    return counted.where((F.col("_n") <= n) | (at(F.col("_p") + 1) > at(F.col("_p")))).drop("_n", "_p")


def ordinary_days(prices: DataFrame, index: DataFrame, sessions: DataFrame, *, lookback: int, least_turnover: float, least_price: float, most_gap: float, ahead: dict[str, int], most_move: float) -> DataFrame:
    """What a stock bought at the open of a day gives against the index: symbol, day, session_no and rel_ of each horizon (sessions ahead, 0 being the day's own close).

    prices: symbol, day, open, high, low, close, prev_close, turnover; index: day, open, close; sessions: day, session_no. Days count that have lookback recorded ones before them of a median turnover not too small, a price not
    too low, a range and no circuit gap. A move over most_move beyond the day itself is taken for a split and says nothing.
    """
    from epochlens.operators.windows import rolling_median_rows

    p = rolling_median_rows(prices, ["symbol"], ["day"], "turnover", lookback, "_med")
    whole = F.lit(True)
    for c in ("open", "prev_close", "high", "low"):
        whole &= F.coalesce(F.col(c) != 0, F.lit(False))
    good = whole & (F.col("_med") >= least_turnover) & (F.col("prev_close") >= least_price) & (F.col("high") != F.col("low")) & (F.abs(F.try_divide("open", "prev_close") - 1) < most_gap)
    i = index.join(sessions, "day").select("day", "session_no", F.col("open").alias("_io"), F.col("close").alias("_ic"))
    i = i.where("_io <> 0 and _ic <> 0")
    live = p.where(good).join(F.broadcast(i.select("day", "session_no", "_io")), "day")  # a row for each session
    ends = F.broadcast(i.select(F.col("session_no").alias("_end"), F.col("day").alias("_exit"), "_ic"))
    asked = live.select("symbol", "day", "session_no", "open", "_io", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for n, k in ahead.items()))).alias("h")).select("*", "h.*").withColumn("_end", F.col("session_no") + F.col("k"))
    closes = prices.select("symbol", F.col("day").alias("_exit"), F.col("close").alias("_c"))
    met = asked.join(ends, "_end").join(closes, ["symbol", "_exit"], "left")
    stock = F.try_divide(F.nullif("_c", F.lit(0.0)), F.col("open")) - 1
    rel = F.when((F.col("k") == 0) | (F.abs(stock) <= most_move), stock - (F.try_divide("_ic", "_io") - 1))
    met = met.withColumn("_rel", rel)
    found = met.groupBy("symbol", "day").agg(*(F.max(F.when(F.col("name") == n, F.col("_rel"))).alias(f"rel_{n}") for n in ahead))
    return live.select("symbol", "day", "session_no").join(found, ["symbol", "day"], "left")
