"""Whole studies: filings to events with one reason each for not counting, and to returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.operators import windows
from epochlens.operators.calendar import next_open
from epochlens.session import materialised


def first_of(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; an unknown one counts as not holding."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def _symbol_on(names: Column, day: Column) -> Column:
    """The symbol of the one window of a security's names that holds the day; null unless exactly one does."""
    held = F.filter(names, lambda w: F.coalesce(w["valid_from"] <= day, F.lit(True)) & F.coalesce(day < w["valid_to"], F.lit(True)))
    return F.when(F.size(held) == 1, held[0]["symbol"])


def study_answers(asked: DataFrame, names: DataFrame, prices: DataFrame, actions: DataFrame, sessions: DataFrame, *, exits: dict[str, int], lookback: int) -> DataFrame:
    """All that a study asks of a (security_id, entry_day, entry_no), each asked once: prices of all sessions concerned by one join, corporate actions by another.

    A security's names and a symbol's actions are short lists (some tens over years) that travel with the question. Gives listed, symbol, open, high, low, prev_close,
    median_turnover over the sessions before (days without a bar count as zero), last_exit, the entry day's multiplier, review and for each exit close_ and mult_.
    """
    last = max(exits.values())
    lists = names.groupBy("security_id").agg(F.collect_list(F.struct("symbol", "valid_from", "valid_to")).alias("_names"))
    named = asked.join(lists, "security_id", "left")
    offsets = sorted({*range(-lookback, 1), *exits.values()})
    at = F.broadcast(sessions.select(F.col("session_no").alias("_no"), F.col("day").alias("_day")))  # a row for each session of the calendar
    wanted = named.withColumn("_off", F.explode(F.array(*map(F.lit, offsets)))).withColumn("_no", F.col("entry_no") + F.col("_off")).join(at, "_no", "left")
    wanted = wanted.select("security_id", "entry_day", F.col("_names").isNotNull().alias("listed"), "_off", "_day", _symbol_on(F.col("_names"), F.col("_day")).alias("_symbol"))
    bars = prices.select(F.col("symbol").alias("_symbol"), F.col("day").alias("_day"), "open", "high", "low", "close", "prev_close", "turnover")
    seen = wanted.join(bars, ["_symbol", "_day"], "left")
    on = lambda n, c: F.max(F.when(F.col("_off") == n, F.col(c)))
    facts = seen.groupBy("security_id", "entry_day").agg(
        F.max("listed").alias("listed"), on(0, "_symbol").alias("symbol"), *(on(0, c).alias(c) for c in ("open", "high", "low", "prev_close")),
        F.percentile(F.when(F.col("_off") < 0, F.coalesce("turnover", F.lit(0.0))), F.lit(0.5)).alias("median_turnover"), on(last, "_day").alias("last_exit"),
        *(x for name, n in exits.items() for x in (on(n, "_day").alias(f"exit_{name}"), on(n, "close").alias(f"close_{name}"))),
    )
    listed_actions = actions.groupBy("symbol").agg(F.collect_list(F.struct("day", "multiplier", "review")).alias("_actions"))
    facts = facts.join(listed_actions, "symbol", "left").withColumn("_actions", F.coalesce("_actions", F.slice(F.array(F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("multiplier"), F.lit(None).cast("boolean").alias("review"))), 1, 0)))

    def product(holds) -> Column:
        return F.aggregate(F.filter("_actions", lambda a: F.coalesce(holds(a) & a["multiplier"].isNotNull(), F.lit(False))), F.lit(1.0), lambda x, a: x * a["multiplier"])

    entry = F.col("entry_day")
    facts = facts.withColumn("entry_multiplier", product(lambda a: a["day"] == entry)).withColumn("review", F.exists("_actions", lambda a: F.coalesce(a["review"] & a["day"].between(entry, F.col("last_exit")), F.lit(False))))
    for name in exits:
        facts = facts.withColumn(f"mult_{name}", product(lambda a, name=name: (a["day"] > entry) & (a["day"] <= F.col(f"exit_{name}"))))
    return facts.drop("_actions")


def daily_study(
    filings: DataFrame, names: DataFrame, prices: DataFrame, bench: DataFrame, actions: DataFrame, cal: DataFrame, *, first: str, last: str, exits: dict[str, int], excluded: list[str], lookback: int, least_turnover: float, least_price: float, most_gap: float, cooldown: int, round_trip: float, keep: Column | None = None
) -> DataFrame:
    """Every filing with its entry session, the first reason for which it doesn't count, and its returns for each exit.

    filings: filing_id, event_type, category, available_at, security_id. prices: symbol, day, open, high, low, close, prev_close, turnover. bench: day, open, close.
    actions: symbol, day, multiplier, review. keep: a reason of a registered filter of one's own (null keeps), looked at before any price. Reasons in
    order: excluded_category, outside_window, unlinked, keep's own, no_nse_listing, no_entry_price, low_price, illiquid, locked_entry, circuit_gap, review_action,
    duplicate. Gives ret_, bench_, abnormal_ and net_ of each exit; a stock's return is kept right over splits by their multipliers after the entry day.
    Each (security, entry day) is asked for once (study_answers), however many filings enter there; filings that are out before any price is looked at take no part in joins.
    """
    sessions = cal.where("session_no is not null").select("day", "session_no")
    entered = next_open(filings, cal, "available_at")
    entered = entered.join(F.broadcast(sessions.select(F.col("day").alias("entry_day"), F.col("session_no").alias("entry_no"))), "entry_day", "left")  # a row for each session
    early = first_of(
        ("excluded_category", F.lower("category").isin([c.lower() for c in excluded])), ("outside_window", F.col("entry_day").isNull() | ~F.col("entry_day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))), ("unlinked", F.col("security_id").isNull())
    )
    rows = entered.withColumn("reason", F.coalesce(early, keep if keep is not None else F.lit(None).cast("string")))
    rows = rows.select("filing_id", "event_type", "security_id", "available_at", "entry_day", "entry_no", "reason")
    out, live = rows.where("reason is not null"), rows.where("reason is null")
    answers = study_answers(live.select("security_id", "entry_day", "entry_no").distinct(), names, prices, actions, sessions, exits=exits, lookback=lookback)
    live = live.drop("reason").join(answers, ["security_id", "entry_day"], "left")
    gap = F.try_divide(F.col("open") * F.col("entry_multiplier"), F.col("prev_close")) - 1
    live = live.withColumn("reason", first_of(
        ("no_nse_listing", ~F.col("listed")), ("no_entry_price", F.col("symbol").isNull() | F.col("open").isNull() | F.col("prev_close").isNull() | (F.col("open") <= 0)), ("low_price", F.col("prev_close") < least_price), ("illiquid", F.col("median_turnover") < least_turnover),
        ("locked_entry", F.col("high") == F.col("low")), ("circuit_gap", F.abs(gap) >= most_gap), ("review_action", F.col("review")),
    ))
    live = materialised(live, "study")
    held = windows.cooldown(live.where("reason is null"), ["security_id", "event_type"], ["available_at", "filing_id"], "entry_no", cooldown)
    counted = held.where("kept").drop("kept")
    opened = F.broadcast(bench.select(F.col("day").alias("entry_day"), F.col("open").alias("_bo")))  # a row for each session
    counted = counted.join(opened, "entry_day", "left")
    results = []
    for name in exits:
        closed = F.broadcast(bench.select(F.col("day").alias(f"exit_{name}"), F.col("close").alias(f"_bc_{name}")))
        counted = counted.join(closed, f"exit_{name}", "left")
        ret, index = F.try_divide(F.col(f"close_{name}") * F.col(f"mult_{name}"), F.col("open")) - 1, F.when(F.col("_bo") > 0, F.try_divide(F.col(f"_bc_{name}"), F.col("_bo")) - 1)
        results += [ret.alias(f"ret_{name}"), index.alias(f"bench_{name}"), (ret - index).alias(f"abnormal_{name}"), (ret - index - round_trip).alias(f"net_{name}")]
    shape = ["filing_id", "event_type", "security_id", "symbol", "entry_day", "reason"]
    rest = live.where("reason is not null").select(shape).unionByName(held.where("not kept").withColumn("reason", F.lit("duplicate")).select(shape))
    rest = rest.unionByName(out.select(*(c for c in shape if c != "symbol")), allowMissingColumns=True)
    return counted.select(*shape, *results).unionByName(rest, allowMissingColumns=True)


def size_filter(amount: Column, revenue: Column, least: float) -> Column:
    """Reason of the magnitude re-test: an amount that is unknown, a revenue that is unknown, or a share of it that is too small."""
    return F.when(amount.isNull(), "no_amount").when(revenue.isNull() | (revenue <= 0), "no_revenue").when(F.try_divide(amount, revenue) < least, "below_magnitude")


def gap_days(prices: DataFrame, ex_dates: DataFrame, bands: DataFrame, *, lookback: int, least_turnover: float, least_price: float, gap_edges: list[float], liquidity_edges: list[float], band_margin: float) -> DataFrame:
    """Every stock-day with the first reason why it is no tradeable gap-up, its gap, its liquidity bucket and gap bin, and what a short from open to close gains.

    prices: symbol, day, open, high, low, close, prev_close, turnover. The median is over the recorded days before; fewer than lookback of them are illiquid.
    """
    from epochlens.functions.scalars import bucket

    p = windows.rolling_median_rows(prices, ["symbol"], ["day"], "turnover", lookback, "median_turnover")
    p = p.join(ex_dates.select("symbol", "day").distinct().withColumn("_ex", F.lit(True)), ["symbol", "day"], "left").join(bands.select("symbol", "band"), "symbol", "left")
    whole = F.lit(True)
    for c in ("open", "close", "prev_close", "high", "low"):
        whole &= F.coalesce(F.col(c) != 0, F.lit(False))
    gap = F.when(whole, F.try_divide(F.col("open"), F.col("prev_close")) - 1)  # no price, no gap, no bin, no gain
    reason = first_of(
        ("no_price", ~whole), ("ex_date", F.col("_ex")), ("low_price", F.col("prev_close") < least_price), ("illiquid", F.col("median_turnover").isNull() | (F.col("median_turnover") < least_turnover)), ("locked", F.col("high") == F.col("low")),
        ("no_gap_up", gap < gap_edges[0]), ("circuit_gap", gap >= gap_edges[-1]), ("near_band", gap >= F.col("band") - band_margin),
    )
    return p.select("symbol", "day", reason.alias("day_reason"), gap.alias("gap"), bucket(F.col("median_turnover"), liquidity_edges).alias("liquidity"), bucket(gap, gap_edges).alias("gap_bin"), F.when(whole, 1 - F.try_divide(F.col("close"), F.col("open"))).alias("short_gross"))


def gap_fade(events: DataFrame, days: DataFrame, filed: DataFrame) -> DataFrame:
    """Filings made outside market hours, each with the stock-day that it would trade, the first reason against, and its effect over matched controls.

    events: filing_id, security_id, symbol, entry_day, in_session, too_late, at; days: gap_days' rows with security_id; filed: security_id, day of any filing. Controls are gap-ups of
    the same day, liquidity bucket and gap bin whose known company filed nothing. Reasons in order: outside_window, in_session, too_late, no_symbol, then of
    each company and day only the first filing that can be priced counts (duplicate), and the stock-day's own.
    """
    early = first_of(("outside_window", F.col("entry_day").isNull()), ("in_session", F.col("in_session")), ("too_late", F.col("too_late")), ("no_symbol", F.col("symbol").isNull()))
    e = events.withColumn("reason", early)
    own = days.drop("security_id").withColumnRenamed("day", "entry_day").withColumn("_have", F.lit(True))
    priced = e.where("reason is null").join(own, ["symbol", "entry_day"], "left").withColumn("_day_reason", F.when(F.col("_have").isNull(), "no_price").otherwise(F.col("day_reason")))
    first = priced.where("_day_reason is null").groupBy("security_id", "entry_day").agg(F.min(F.struct("at", "filing_id")).alias("_first"))
    ranked = priced.join(first, ["security_id", "entry_day"], "left")
    # a filing after the one that was taken is a duplicate whatever its stock-day says
    later = F.col("_first").isNotNull() & (F.struct("at", "filing_id") > F.col("_first"))
    ranked = ranked.withColumn("reason", F.when(later, "duplicate").otherwise(F.col("_day_reason")))
    calm = days.where("day_reason is null and security_id is not null").join(filed.select("security_id", "day").distinct(), ["security_id", "day"], "left_anti")
    cells = calm.groupBy(F.col("day").alias("entry_day"), "liquidity", "gap_bin").agg(F.count("*").alias("controls"), F.avg("short_gross").alias("control_gross"))
    kept = ranked.where("reason is null").join(cells, ["entry_day", "liquidity", "gap_bin"], "left").withColumn("effect", F.col("short_gross") - F.col("control_gross"))
    shape = ["filing_id", "security_id", "symbol", "entry_day", "reason", "short_gross", "controls", "control_gross", "effect"]
    rest = ranked.where("reason is not null").select("filing_id", "security_id", "symbol", "entry_day", "reason").unionByName(e.where("reason is not null").select("filing_id", "security_id", "symbol", "entry_day", "reason"))
    return kept.select(*shape).unionByName(rest, allowMissingColumns=True)
