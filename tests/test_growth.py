"""What made queries fail on larger tables, and doesn't any more; each on a table small enough for a test."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from epochlens.functions.scalars import DATE_FORMATS, TIME_FORMATS, ordered_sum, parse_date, parse_exchange_time
from epochlens.operators import ledger, stats
from epochlens.sources import feeds, tabular


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjusted_p_values_over_several_ranges(spark):
    """No frame looks at all the rows behind each, and ranges carry over to each other, ties and families apart."""
    r = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None, r.choice([r.random(), 0.25, None, float("nan")])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, f string, p double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for family in ([], ["f"]):
            out = stats.bh_adjust(df, family, "p", ["k"])
            assert "currentrow$(), unboundedfollowing" not in plan_of(out).lower()
            found = {x["k"]: x["p_adjusted"] for x in out.collect()}
            wanted = dict.fromkeys(found)
            for f in {x[1] for x in rows} if family else {0}:
                live = sorted((p, k) for k, g, p in rows if p is not None and p == p and (not family or g == f))
                best = 1.0
                for rank in range(len(live), 0, -1):
                    best = min(best, live[rank - 1][0] * len(live) / rank)
                    wanted[live[rank - 1][1]] = best
            assert len(found) == len(rows) and found == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_results_files_are_parsed_once(spark):
    """First facts of a context by local name, whatever the prefix and depth; no further parse for each name."""
    text = "<r xmlns:a='x'><a:context id='Two'><a:period><a:endDate>2020-01-01</a:endDate></a:period></a:context><a:context id='OneD'><a:period><a:startDate>2024-01-01</a:startDate><a:endDate>2024-03-31</a:endDate></a:period></a:context><g><a:Symbol contextRef='Two'>NO</a:Symbol><a:Symbol contextRef='OneD'> A<!-- c --><b>B</b> </a:Symbol></g><Symbol contextRef='OneD'>LATER</Symbol><a:RevenueFromOperations contextRef='OneD'>1,234.5</a:RevenueFromOperations></r>"
    out = feeds.xbrl_facts(spark.createDataFrame([(1, text), (2, None), (3, "<r/>"), (4, "")], "doc int, payload string"))
    assert "xpath" not in plan_of(out).lower()
    found = {r["doc"]: (r["symbol"], r["isin"], str(r["period_start"]), str(r["period_end"]), r["consolidated"], r["revenue"]) for r in out.collect()}
    nothing = (None, None, "None", "None", None, None)
    assert found == {1: ("AB", None, "2024-01-01", "2024-03-31", None, 1234.5), 2: nothing, 3: nothing, 4: nothing}
    with pytest.raises(Exception, match="(?i)xml|not well-formed|parse"):
        feeds.xbrl_facts(spark.createDataFrame([(1, "<r>")], "doc int, payload string")).collect()


def test_files_are_read_piece_by_piece(spark):
    """A long file comes in pieces that hold all its records in order; faults are told by the whole file, once."""
    long = "\n".join(["Symbol,Series,Band", "S", *(f"S{i},EQ,{i}" for i in range(4999))])
    files = [(1, long), (2, "Symbol,Series\na,b\n" * 3000), (3, " <!DOCTYPE html>\n" + "x,y\n" * 5000), (4, "Symbol,Series,Band\n"), (5, None), (6, "")]
    read = tabular.read_records(spark.createDataFrame([(i, None if x is None else x.encode()) for i, x in files], "file int, content binary"))
    pieces = read.where("file = 1").orderBy("part").collect()
    assert max(len(x["records"]) for x in pieces) <= 2000
    assert [r for x in pieces for r in x["records"]] == tabular.records_of(long.encode())
    good, bad = tabular.sort_out(read.where("file <> 1"), ["SYMBOL", "SERIES", "BAND"])
    assert good.count() == 0
    lacking = "missing columns BAND, SERIES, SYMBOL"
    assert sorted(map(tuple, bad.select("file", "error").collect())) == [(2, "missing columns BAND"), (3, "HTML"), (4, lacking), (5, lacking), (6, lacking)]
    # as quarantine says of the same files whole
    whole = spark.createDataFrame([(i, None if x is None else x.encode()) for i, x in files], "file int, content binary").withColumn("records", tabular.table_records(F.col("content")))
    assert sorted(map(tuple, tabular.quarantine(whole, "records", ["SYMBOL", "SERIES", "BAND"])[1].select("file", "error").collect())) == sorted(map(tuple, tabular.sort_out(read, ["SYMBOL", "SERIES", "BAND"])[1].select("file", "error").collect()))


def test_fills_are_dealt_out_once(spark):
    """One shuffle by key serves a trade's sides, cuts and sweep."""
    fills = spark.createDataFrame([("a", i, "sell" if i % 3 == 2 else "buy", 2.0, 10.0 + i, 0.1) for i in range(9)], "k string, n int, side string, q double, price double, c double")
    trades = ledger.fifo_trades(fills, ["k"], ["n"], "side", "q", "price", "c")
    assert trades._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert trades._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r["buy_at"]["n"], r["sell_at"]["n"], r["quantity"]) for r in trades.orderBy("sell_at").collect()] == [(0, 2, 2.0), (1, 5, 2.0), (3, 8, 2.0)]


def test_sums_in_order(spark):
    """A sum on an edge doesn't hang on how its rows are dealt out."""
    rows = [(0, 1e16), (1, 1.0), (2, -1e16), (3, None), (4, 1.0)]
    for parts in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(parts, "n int, v double").repartition(3)
        assert df.agg(ordered_sum("v", "n").alias("s")).first()["s"] == ((1e16 + 1.0) - 1e16) + 1.0
    assert spark.createDataFrame([(0, None)], "n int, v double").agg(ordered_sum("v", "n").alias("s")).first()["s"] is None


def test_facts_of_order_wins_are_read_once(spark):
    """Labels and predictions are made of facts written down, not of texts read again."""
    from epochlens.plans import catalog

    assert "ArrowEvalPython" not in plan_of(catalog.queries()["order_win_scores"](spark, SMALL))


def test_waiting_filings_are_held_by_bucket():
    """Many keys take one read and one write of the state and one timer, whichever of them are due."""
    import pandas as pd

    from epochlens.streaming.stateful import Waiting

    class Handle:
        def __init__(self):
            self.rows, self.timers, self.calls = [], set(), 0

        def getListState(self, name, schema):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.calls += 1
            self.rows = rows

        def clear(self):
            self.rows = []

        def listTimers(self):
            return iter(list(self.timers))

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

        def getCurrentWatermarkInMs(self):
            return 0

        def getExpiryTimeInMs(self):
            return self.now

    handle, waiting = Handle(), Waiting(10, 100)
    waiting.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "us", "kind", "security_id"])
    go = lambda out: sorted(tuple(r) for part in out for r in part.itertuples(index=False))
    first = [(k, k * 1_000_000 + 1, "filing", float(k) if k % 2 else None) for k in range(500)] + [(k, k * 1_000_000 + 5, "facts", None) for k in range(0, 500, 5)]
    told = go(waiting.handleInputRows((0,), iter([frame(first[:300]), frame(first[300:])]), handle))
    assert told == [(k, k * 1_000_000 + 5, "with_facts" if k % 2 else "dropped") for k in range(0, 500, 5)]
    assert handle.calls <= 2 and len(handle.timers) == 1
    assert min(handle.timers) == 11_001  # key 1 waits the longest; rounded up
    handle.now = 200_001
    over = go(waiting.handleExpiredTimer((0,), handle, handle))
    assert over == [(k, (k + 10) * 1_000_000 + 1, "without_facts" if k % 2 else "dropped") for k in range(191) if k % 5]
    assert len(handle.timers) == 1 and {r[0] for r in handle.rows} == set(range(91, 500))  # the others are forgotten
    assert go(waiting.handleInputRows((0,), iter([frame([(100, 5, "filing", 7.0), (600, 3, "facts", None)])]), handle)) == []  # polled again; facts alone
    handle.now = 10**9
    assert len(go(waiting.handleExpiredTimer((0,), handle, handle))) == sum(1 for k in range(191, 500) if k % 5)
    assert handle.rows == [] and not handle.timers


def test_more_rows_are_flattened_by_more_tasks(spark, monkeypatch):
    """One aggregation, whose tasks have so many rows each; of several values of an exit the smallest, nulls apart."""
    from epochlens.operators import coverage

    rows = [(k % 40, "d0" if k % 2 else "d1", None if k % 7 == 0 else float(k)) for k in range(200)] + [(99, "d5", 1.0)]
    df = spark.createDataFrame(rows, "k int, e string, v double")
    monkeypatch.setattr(coverage, "ROWS_A_TASK", 20)
    out = coverage.flattened(df, ["k"], "e", ["v"], ["d0", "d1"])
    plan = plan_of(out)
    assert plan.count("Aggregate ") == 1 and "RepartitionByExpression [k#" in plan and ", 11" in plan
    least = lambda k, e: min((v for a, b, v in rows if a == k and b == e and v is not None), default=None)
    assert sorted(map(tuple, out.collect())) == [(k, least(k, "d0"), least(k, "d1")) for k in [*range(40), 99]]


def test_amounts_are_tried_at_digits_only(monkeypatch):
    """The pattern of amounts is tried where digits begin and at marks right before, not at every sign; what is found is what it finds anywhere."""
    import re

    from epochlens.functions import money

    real, tries = money._AMOUNT, []

    class Counted:
        def match(self, text, at):
            tries.append(at)
            return real.match(text, at)

    r = random.Random(2)
    pieces = ["rs.", "Rupees", "INR", "₹", "us $", "$", "eur", " ", "  ", "1", "12", "1,234", "1, 200", "45.6", ".", ",", "-", " to ", "/-", "lakh", "crores", "million(s)", "x", "A", "only", "ſ", "K", "²", "٣"]
    for text in ("".join(r.choices(pieces, k=r.randint(1, 14))) for _ in range(5000)):
        assert [m.span() for m in money._figures(text)] == [m.span() for m in real.finditer(text)], text
    monkeypatch.setattr(money, "_AMOUNT", Counted())
    assert [x["amount"] for x in money.find_amounts("word " * 1000 + "Rs. 5 crore" + " word" * 1000)] == [5e7]
    assert len(tries) < 10 and isinstance(real, re.Pattern)


@pytest.mark.parametrize(("reader", "body"), [("paged", '{"Table": [%s], "Table1": [{"ROWCNT": 120}]}'), ("listed", "[%s]")])
def test_fields_of_a_record_are_folded_once(spark, reader, body):
    """A record's keys are folded once, not for each field and for each layout of a time that is tried."""
    record = '{"newsID": "N1", " Dissemdt ": "2024-01-15T10:00:00", "NEWS_DT": "15-01-2024 09:00:00", "seq_id": "7", "AN_DT": "15-Jan-2024 10:00:00", "exchDissTime": "15-Jan-2024 10:00:09", "difference": "00:00:08"}'
    payloads = spark.createDataFrame([(body % record,)], "payload string")
    found = feeds.paged_announcements(payloads, attachment_base="http://a/") if reader == "paged" else feeds.listed_announcements(payloads)
    assert 1 <= plan_of(found).count("transform_keys(") <= 8
    row = found.select("*", F.unix_seconds("event_ts").alias("s")).first()
    if reader == "paged":
        assert (row["source_id"], row["total_pages"], row["s"]) == ("N1", 3, 1705293000)
    else:
        assert (row["source_id"], row["s"], row["drift"]) == ("7", 1705293009, True)


def test_more_announcements_make_more_pages(spark, monkeypatch):
    """A page holds some rows, however many a day has."""
    from epochlens.plans import feeds as plans

    held = []
    read = feeds.paged_announcements
    monkeypatch.setattr(feeds, "PAGE_ROWS", 5)
    monkeypatch.setattr(feeds, "paged_announcements", lambda pages, **k: held.append(pages) or read(pages, **k))
    found = plans.source_paged_announcements(spark, SMALL)
    sizes = [r["n"] for r in held[0].select(F.size(F.from_json("payload", "Table array<map<string,string>>")["Table"]).alias("n")).collect()]
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert sum(sizes) == events.count() and max(sizes) <= 20 and len(sizes) > 100
    assert found.count() == events.where("event_id % 17 <> 0").count()


def test_dates_and_times_in_every_layout(spark):
    """Each layout is read, in any case; texts that only begin like one, or hold days that don't exist, are null."""
    at, one = F.timestamp_seconds(F.lit(1705315509)), spark.range(1)
    for f in TIME_FORMATS:
        for change in (F.col, F.upper, F.lower):
            row = one.select(F.date_format(at, f).alias("t")).select(F.unix_seconds(parse_exchange_time(change("t"))).alias("s")).first()
            assert row["s"] == 1705315509 - 19800 - (0 if "ss" in f else 9)
    for f in DATE_FORMATS:
        assert str(one.select(F.date_format(at, f).alias("t")).select(parse_date(F.concat(F.lit(" "), F.upper("t"), F.lit("\n"))).alias("d")).first()["d"]) == "2024-01-15"
    odd = spark.createDataFrame([("2024-01-15T10:00:00+05:30", 1705293000), ("2024-01-15T04:30:00Z", 1705293000), ("2024-02-30 10:00:00", None), ("15-Foo-2024 10:00", None), ("15-01-2024", None), ("2024-01-15 10:00:00 x", None), ("--", None), (None, None)], "t string, s long")
    assert all(r["s"] == r["found"] for r in odd.select("s", F.unix_seconds(parse_exchange_time(F.col("t"))).alias("found")).collect())
