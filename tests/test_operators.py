"""Semantics of single operators on small fixtures, against plain Python."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from epochlens.functions import scalars, taxonomy
from epochlens.operators import asof, calendar, graph, identity, ledger, merge, pit, stats, windows


def test_clock_never_goes_back(spark):
    clock = pit.AsOf(datetime(2024, 1, 2, tzinfo=timezone.utc))
    with pytest.raises(ValueError):
        clock.advance(datetime(2024, 1, 1, tzinfo=timezone.utc))
    with pytest.raises(ValueError):
        pit.AsOf(datetime(2024, 1, 2))


def test_read_hides_what_was_not_known(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp '2024-01-01' AS available_at UNION ALL SELECT 2, timestamp '2024-01-03' UNION ALL SELECT 3, NULL")
    assert [r["k"] for r in pit.AsOf(datetime(2024, 1, 2, tzinfo=timezone.utc)).read(rows).collect()] == [1]


def test_flags_before_first_record_are_unknown(spark):
    versions = spark.createDataFrame([("a", "X", date(2024, 1, 5), None), ("b", "Y", date(2024, 1, 6), date(2024, 1, 8))], "e string, flag string, valid_from date, valid_to date")
    asked = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 6)), ("b", date(2024, 1, 8)), ("c", date(2024, 1, 9))], "e string, day date")
    found = {(r["e"], r["day"].day): r["flags"] for r in pit.flags_on(versions, asked, "e", "day", "flag").collect()}
    assert found == {("a", 1): None, ("a", 6): ["X"], ("b", 8): [], ("c", 9): []}


def test_insert_ignore_and_upsert(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert sorted(map(tuple, merge.insert_ignore(target, batch, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, merge.upsert(target, batch.where("v <> 'd'"), ["k"], ["v"]).collect())) == [(1, "b"), (2, "c")]


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_is_a_fold(spark, seed):
    r = random.Random(seed)
    rows = sorted({(r.choice("ab"), r.randint(0, 60)) for _ in range(60)})
    kept, last = set(), {}
    for k, at in rows:
        if k not in last or at - last[k] > 5:
            kept.add((k, at))
            last[k] = at
    found = windows.cooldown(spark.createDataFrame(rows, "k string, at int"), ["k"], ["at"], "at", 5)
    assert {(x["k"], x["at"]) for x in found.where("kept").collect()} == kept
    assert found.count() == len(rows)


@pytest.mark.parametrize(("direction", "equal"), [("backward", True), ("forward", True), ("forward", False)])
def test_asof_join_against_scan(spark, direction, equal):
    r = random.Random(5)
    zero = datetime(2024, 1, 1)
    left = [(k, r.choice("ab"), r.randint(0, 30)) for k in range(40)]
    right = sorted({(r.choice("ab"), r.randint(0, 30)) for _ in range(25)})
    a = spark.createDataFrame([(k, g, zero + timedelta(seconds=s)) for k, g, s in left], "k int, g string, ts timestamp")
    b = spark.createDataFrame([(g, zero + timedelta(seconds=s), s) for g, s in right], "g string, at timestamp, hit int")
    found = asof.asof_join(a, b, by=["g"], left_ts="ts", right_ts="at", take=["hit"], direction=direction, allow_equal=equal)
    for row in found.collect():
        s = int((row["ts"] - zero).total_seconds())
        ok = [x for g, x in right if g == row["g"] and (x <= s if direction == "backward" else x > s or (equal and x == s))]
        assert row["hit"] == ((max if direction == "backward" else min)(ok) if ok else None)
    assert found.count() == 40


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(50)] + [(200, k) for k in range(201, 260)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {row["node"]: row["root"] for row in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: find(k) for k in root}


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_components_of_few_edges_need_no_rounds(spark, kind):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(80)] + [(2000, k) for k in range(2001, 2200)]
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a").cast("string").cast(kind).alias("a"), F.col("b").cast("string").cast(kind).alias("b")).repartition(3)

    def run(group, **args):
        spark.sparkContext.setJobGroup(group, group)
        found = graph.components(df, **args)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return {(bytes(x) if kind == "binary" else x): (bytes(y) if kind == "binary" else y) for x, y in found.collect()}, jobs

    by_rounds, many = run(f"rounds-{kind}", few=0)
    at_once, some = run(f"few-{kind}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert at_once == by_rounds
    assert some <= 8 < many
    assert graph.components(df.where("false")).count() == 0


def test_calendar_weekend_session_is_special(spark):
    loaded = spark.createDataFrame([(date(2024, 1, d),) for d in (4, 5, 6, 9)], "day date")
    off = spark.createDataFrame([(date(2024, 1, 8),)], "day date")
    found = {r["day"].day: (r["is_session"], r["is_special"], r["session_no"]) for r in calendar.calendar(loaded, off).collect()}
    assert found == {4: (True, False, 1), 5: (True, False, 2), 6: (True, True, None), 7: (False, False, None), 8: (False, False, None), 9: (True, False, 3)}


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.20, None]
    rows = spark.createDataFrame(list(enumerate(ps)), "k int, p double").withColumn("f", F.lit("x"))
    found = {r["k"]: r["p_adjusted"] for r in stats.bh_adjust(rows, ["f"], "p", ["k"]).collect()}
    known = sorted((p, k) for k, p in enumerate(ps) if p is not None)
    best, wanted = 1.0, {4: None}
    for rank in range(len(known), 0, -1):
        p, k = known[rank - 1]
        best = min(best, p * len(known) / rank)
        wanted[k] = best
    assert found[4] is None
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in range(4))


def test_rename_chain(spark):
    """A name that is used again starts when its earlier holder left it."""
    changes = spark.createDataFrame([("A", "B", date(2020, 1, 1)), ("B", "C", date(2021, 1, 1)), ("X", "B", date(2022, 1, 1))], "old string, new string, effective date")
    found = {(r["name"], r["holder"]): (r["valid_from"], r["valid_to"]) for r in identity.rename_windows(changes).collect()}
    assert found == {("A", "C"): (None, date(2020, 1, 1)), ("B", "C"): (date(2020, 1, 1), date(2021, 1, 1)), ("C", "C"): (date(2021, 1, 1), None), ("X", "B"): (None, date(2022, 1, 1)), ("B", "B"): (date(2022, 1, 1), None)}


# fixed values: one-sided critical values of Student's t
CRITICAL = [(6.314, 1, 0.05), (2.920, 2, 0.05), (2.015, 5, 0.05), (3.365, 5, 0.01), (1.812, 10, 0.05), (2.764, 10, 0.01), (1.697, 30, 0.05), (2.423, 40, 0.01), (1.960, math.inf, 0.025), (2.326, math.inf, 0.01)]


@pytest.mark.parametrize(("t", "df", "p"), CRITICAL)
def test_student_tail(t, df, p):
    assert stats.student_tail(t, df) == pytest.approx(p, abs=1.5e-4)
    assert stats.student_tail(-t, df) == pytest.approx(1 - p, abs=1.5e-4)


def test_student_tail_at_the_ends():
    assert stats.student_tail(0.0, 7) == 0.5 and stats.student_tail(math.inf, 3) == 0.0
    assert math.isnan(stats.student_tail(math.nan, 3)) and math.isnan(stats.student_tail(1.0, 0))
    assert stats.student_tail(1.0, 1) == pytest.approx(0.25)


def test_lots_and_oversell(spark):
    """Pro-rata charges of what is left, and no sell beyond what is held."""
    fills = [("a", 1, "buy", 10.0, 100.0, 1.0), ("a", 2, "buy", 10.0, 110.0, 2.0), ("a", 3, "sell", 15.0, 120.0, 3.0)]
    df = spark.createDataFrame(fills, "k string, n int, side string, q double, price double, c double")
    lots = ledger.open_lots(df, ["k"], ["n"], "side", "q", "price", "c").collect()
    assert [(r["buy_at"]["n"], r["open_quantity"], r["price"], r["charges"]) for r in lots] == [(2, 5.0, 110.0, 1.0)]
    trades = ledger.fifo_trades(ledger.covered(df, ["k"], ["n"], "side", "q"), ["k"], ["n"], "side", "q", "price", "c").orderBy("buy_at").collect()
    assert [(r["quantity"], r["pnl"]) for r in trades] == [(10.0, 200.0 - 1.0 - 2.0), (5.0, 50.0 - 1.0 - 1.0)]
    short = spark.createDataFrame([("a", 1, "sell", 5.0, 100.0, 0.0), ("a", 2, "buy", 5.0, 90.0, 0.0)], df.schema)
    assert [(r["k"], r["most"]) for r in ledger.oversold(short, ["k"], ["n"], "side", "q").collect()] == [("a", 5.0)]
    with pytest.raises(Exception, match="sold more than held"):
        ledger.fifo_trades(ledger.covered(short, ["k"], ["n"], "side", "q"), ["k"], ["n"], "side", "q", "price").collect()


def test_repeated_rows_stay(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 2), date(2024, 1, 9))] * 2 + [(None, None, None)], "k string, s date, e date")
    days = spark.createDataFrame([("a", date(2024, 1, 5), 2.0), ("a", date(2024, 1, 2), 3.0)], "k string, d date, f double")
    assert sorted(r["multiplier"] for r in windows.product_between(rows, days, "k", "s", "e", "d", "f").collect()) == [1.0, 2.0, 2.0]
    assert sorted(r["flagged"] for r in windows.any_between(rows, days, "k", "s", "e", "d").collect()) == [False, True, True]
    names = spark.createDataFrame([("a", date(2024, 1, 1), None, 7)], "k string, valid_from date, valid_to date, t int")
    assert sorted(str(r["t"]) for r in asof.resolve_identifier(rows, names, by=["k"], at="s", target="t").collect()) == ["7", "7", "None"]


def test_workbook_is_read_as_a_table():
    """An .xlsx under any name: shared and inline texts, numbers, gaps and blank rows."""
    import io
    import zipfile

    from epochlens.sources import tabular

    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>Symbol</t></si><si><r><t>AB</t></r><r><t>C</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> close </t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12.5</v></c><c r="D3"><v>9</v></c></row></sheetData></worksheet>')
    assert tabular.records_of(body.getvalue()) == [{"SYMBOL": "ABC", "": "", "CLOSE": "12.5"}]
    assert tabular.records_of("\ufeffa, B\n1,2,3\n,\n".encode()) == [{"A": "1", "B": "2"}]
    assert tabular.records_of("é\n1".encode("latin-1")) == [{"É": "1"}]


def test_scalars(spark):
    df = spark.createDataFrame([("1,234.5", "165.57 KB", "-00:01:05"), ("-", "0 KB", "x"), (None, None, None)], "a string, b string, c string")
    found = df.select(scalars.to_number(F.col("a")).alias("a"), scalars.display_size(F.col("b")).alias("b"), scalars.signed_duration(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in found] == [(1234.5, 169544, -65), (None, None, None), (None, None, None)]


def test_first_rule_wins(spark):
    rules = [{"type": "ORDER", "when": [{"text": "order"}]}, {"type": "ANY", "when": [{"text": "order|loss"}]}]
    df = spark.createDataFrame([("New Order",), ("loss",), ("none",), (None,)], "t string")
    found = df.select(taxonomy.compile_rules(rules, [], {"text": F.col("t")})["event_type"].alias("e")).collect()
    assert [r["e"] for r in found] == ["ORDER", "ANY", "OTHER", "OTHER"]
