"""Versions, symbols, stores and streams against plain Python, in any order and any batches."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from epochlens.operators import identity, leaks, merge, reaction, studies, symbols, versions
from epochlens.session import work_path
from epochlens.sources import bars, polled
from epochlens.streaming import ingest, stateful

DAY = date(2024, 1, 1)


# ---- versions


class Plain:
    """Versions as a list, changed snapshot by snapshot."""

    def __init__(self):
        self.rows = []  # owner, key, value, from, to

    def apply(self, owner, day, listed, share):
        met = {r[1]: r for r in self.rows if r[0] == owner and r[3] <= day and (r[4] is None or r[4] > day)}
        whole = listed and len(listed) >= share * len(met)
        later = [r for r in self.rows if r[0] == owner and r[3] > day]
        for k, v in listed.items():
            row = met.get(k)
            if row is None:
                if not any(r[:2] == [owner, k] and r[3] == day for r in self.rows):
                    self.rows.append([owner, k, v, day, min((r[3] for r in later if r[1] == k), default=None)])
            elif row[2] != v:
                if row[3] == day:
                    row[2] = v
                else:
                    self.rows.append([owner, k, v, day, row[4]])
                    row[4] = day
        for k, row in met.items():
            if k not in listed and whole:
                row[4] = day

    def sorted(self):
        return sorted(map(repr, map(tuple, self.rows)))


def snapshots(r, owners="xy", days=6):
    out = []
    for owner in owners:
        for d in range(days):
            keys = [k for k in range(8) if r.random() < 0.8]
            if d and r.random() < 0.35:
                keys = keys[: r.randrange(3)]  # cut short, or empty
            out.append((owner, DAY + timedelta(days=3 * d), {f"{owner}{k}": r.choice("ab") for k in keys}))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_snapshots_in_any_order(spark, seed):
    r = random.Random(seed)
    taken = snapshots(r, days=4)
    r.shuffle(taken)
    plain = Plain()
    now = spark.createDataFrame([], "o string, k string, v string, valid_from date, valid_to date")
    for owner, day, listed in taken:
        plain.apply(owner, day, listed, 0.6)
        snap = spark.createDataFrame([(owner, k, v) for k, v in listed.items()], "o string, k string, v string")
        now = merge.scd2_apply(now, snap, keys=["o", "k"], attrs=["v"], as_of=F.lit(day), least_share=0.6, scope=F.col("o") == owner)
        now = spark.createDataFrame(now.collect(), now.schema)
    assert sorted(map(repr, map(tuple, now.collect()))) == plain.sorted()


@pytest.mark.parametrize("seed", range(6))
def test_rebuilt_versions_equal_snapshots_in_order(spark, seed):
    r = random.Random(100 + seed)
    taken = snapshots(r)
    plain = Plain()
    for owner, day, listed in sorted(taken, key=lambda x: x[1]):
        plain.apply(owner, day, listed, 0.6)
    r.shuffle(taken)
    rows = spark.createDataFrame([(o, d, k, v) for o, d, listed in taken for k, v in listed.items()], "o string, as_of date, k string, v string")
    all_taken = spark.createDataFrame([(o, d) for o, d, _ in taken], "o string, as_of date")
    found = versions.rebuild(rows, all_taken, owner=["o"], keys=["k"], attrs=["v"], least_share=0.6)
    assert sorted(map(repr, map(tuple, found.select("o", "k", "v", "valid_from", "valid_to").collect()))) == plain.sorted()


def test_rebuild_of_nothing(spark):
    rows = spark.createDataFrame([], "o string, as_of date, k string, v string")
    assert versions.rebuild(rows, rows.select("o", "as_of"), owner=["o"], keys=["k"], attrs=["v"]).count() == 0


# ---- symbols


def plain_symbol(changes, symbol, known_on, target):
    current, day = symbol, known_on
    if target < day:
        while into := [c for c in changes if c[1] == current and target < c[2] <= day]:
            current, _, at = max(into, key=lambda c: c[2])
            day = at - timedelta(days=1)
        return current
    while out := [c for c in changes if c[0] == current and day < c[2] <= target]:
        _, current, day = min(out, key=lambda c: c[2])
    return current


@pytest.mark.parametrize("seed", range(2))
def test_symbols_walk_back_and_forward(spark, seed):
    r = random.Random(seed)
    changes, used = [], set()
    for _ in range(40):
        old, new, at = r.choice("ABCDEF"), r.choice("ABCDEF"), DAY + timedelta(days=r.randrange(60))
        if old != new and not {("o", old, at), ("n", new, at)} & used:
            used |= {("o", old, at), ("n", new, at)}
            changes.append((old, new, at))
    late = {c for c in changes if r.random() < 0.2}
    stored = [(*c, datetime(2030 if c in late else 2020, 1, 1)) for c in changes] + [("A", "A", DAY, datetime(2020, 1, 1))]
    asked = [(r.choice("ABCDEFabc"), DAY + timedelta(days=r.randrange(60)), DAY + timedelta(days=r.randrange(60))) for _ in range(60)]
    store = spark.createDataFrame(stored, "old string, new string, effective date, available_at timestamp")
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, symbol string, known_on date, target date")
    for as_of, known in ((F.lit("2025-01-01").cast("timestamp"), [c for c in changes if c not in late]), (None, changes)):
        found = {x["i"]: x["symbol_then"] for x in symbols.symbol_on(rows, store, known_on="known_on", target="target", as_of=as_of).collect()}
        assert found == {i: plain_symbol(known, s.upper(), k, t) for i, (s, k, t) in enumerate(asked)}


def test_a_symbol_used_again_starts_when_it_was_left(spark):
    store = spark.createDataFrame([("OLD", "MID", date(2020, 1, 1)), ("MID", "NEW", date(2021, 1, 1)), ("OLD", "ELSE", date(2022, 1, 1))], "old string, new string, effective date")
    rows = spark.createDataFrame([("NEW", date(2023, 1, 1)), ("OLD", date(2021, 6, 1)), ("nowhere", date(2021, 6, 1))], "symbol string, known_on date")
    found = {(x["symbol"], x["name"]): (x["valid_from"], x["valid_to"]) for x in symbols.symbol_windows(rows, store, known_on="known_on").collect()}
    assert found == {
        ("NEW", "OLD"): (None, date(2020, 1, 1)), ("NEW", "MID"): (date(2020, 1, 1), date(2021, 1, 1)), ("NEW", "NEW"): (date(2021, 1, 1), None),
        ("OLD", "OLD"): (date(2020, 1, 1), date(2022, 1, 1)), ("OLD", "ELSE"): (date(2022, 1, 1), None), ("nowhere", "NOWHERE"): (None, None),
    }


def test_a_change_is_known_by_its_day_at_the_latest(spark):
    store = spark.createDataFrame([], "old string, new string, effective date, available_at timestamp")
    file = spark.createDataFrame([("A", "B", date(2024, 1, 10)), ("C", "D", date(2023, 1, 10))], "old string, new string, effective date")
    first = symbols.record_changes(store, file, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    again = symbols.record_changes(first, file, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert {(r["old"], r["available_at"]) for r in again.collect()} == {("A", datetime(2024, 1, 2)), ("C", datetime(2023, 1, 9, 18, 30))}


# ---- ids across builds


def test_merged_ids_lead_on_and_split_ones_say_so(spark):
    merges = spark.createDataFrame([(1, 1, [5]), (2, 2, [1, 7]), (3, 3, [2]), (3, 9, [])], "build int, security_id long, merged array<long>")
    redirects = identity.redirects(merges)
    assert {(r["old"], r["security_id"]) for r in redirects.collect()} == {(5, 3), (1, 3), (7, 3), (2, 3)}
    roots = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "node string, root string")
    splits = identity.split_ids(roots, spark.createDataFrame([("a", 8), ("b", 8), ("c", 3)], "node string, security_id long"))
    labels = spark.createDataFrame([(1, 5), (2, 8), (3, 4), (4, None), (5, 5)], "label int, security_id long")
    found = {r["label"]: (r["security_id"], r["id_status"]) for r in identity.resolve_ids(labels, redirects, splits, "security_id").collect()}
    assert found == {1: (3, "redirected"), 2: (None, "split"), 3: (4, "same"), 4: (None, None), 5: (3, "redirected")}
    with pytest.raises(RuntimeError):
        identity.redirects(spark.createDataFrame([(1, 1, [2]), (2, 2, [1])], "build int, security_id long, merged array<long>"), rounds=5)


# ---- stores


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


def test_month_store_opens_and_rewrites_what_it_must(spark):
    folder = work_path(spark, "bars-test")
    schema = "instrument_key string, ts timestamp, open double, high double, low double, close double, volume long"
    make = lambda rows: spark.createDataFrame([(k, t.replace(tzinfo=None), v, v, v, v, 1) for k, t, v in rows], schema)
    assert bars.read_bars(spark, folder, utc(2024, 1, 1), utc(2025, 1, 1)).count() == 0
    times = [utc(2024, m, 5, 4) for m in range(1, 7)]
    bars.merge_months(make([(f"E|{i}", t, float(i)) for i in range(20) for t in times]), folder)
    files = lambda df: {x for x in df.inputFiles()}
    before = files(spark.read.parquet(folder))
    bars.merge_months(make([("E|3", times[1], 99.0), ("E|3", times[1] + timedelta(minutes=1), 5.0), ("E|3", times[1] + timedelta(minutes=1), 4.0)]), folder)
    after = files(spark.read.parquet(folder))
    assert len(before - after) == 1 and "month=2024-02" in next(iter(before - after))  # one part of one month is new, all others are the same files
    one = bars.read_bars(spark, folder, utc(2024, 1, 31, 18, 30), utc(2024, 2, 29, 18, 30), ["E|3"])
    assert [(r["ts"].minute, r["open"]) for r in one.orderBy("ts").collect()] == [(0, 99.0), (1, 4.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scanned = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scanned.selectedPartitions().totalNumberOfFiles() == 1  # of one part of one month
    bars.merge_months(make([("E|3", times[1], 99.0)]), folder)
    assert bars.read_bars(spark, folder, utc(2024, 1, 1), utc(2024, 7, 1)).count() == 121
    # a month of exchange time begins at 18:30 the day before; the end is not in the range
    assert bars.months(utc(2024, 1, 31, 18, 30), utc(2024, 2, 29, 18, 30)) == ["2024-02"] and bars.months(utc(2023, 12, 31), utc(2024, 1, 1)) == ["2023-12", "2024-01"] and bars.months(utc(2024, 1, 1), utc(2024, 1, 1)) == []
    with pytest.raises(Exception, match="a bar of 2024-03"):
        bars.merge_months(make([("E|1", times[2], 1.0)]), folder, only=["2024-02"])
    assert bars.read_bars(spark, folder, utc(2024, 3, 1), utc(2024, 4, 1)).count() == 20


def test_polls_resume_and_damage_is_seen(spark):
    polled.register(spark)
    folder, target, checkpoint = (work_path(spark, x) for x in ("polls-test", "target", "checkpoint"))
    make = lambda *xs: spark.createDataFrame([(x.encode(), "k", datetime(2024, 1, 1)) for x in xs], "content binary, kind string, fetched_at timestamp")
    assert spark.read.format(polled.NAME).load(folder).count() == 0
    polled.publish(make("a", "b"), folder)
    ingest.append_to(spark.readStream.format(polled.NAME).load(folder), target, checkpoint)
    polled.publish(make("b", "c", "c"), folder)
    polled.publish(make("a"), folder)  # nothing new
    # files of a poll that wasn't committed are not there
    make("z").withColumn("doc_id", F.sha2("content", 256)).write.parquet(f"{folder}/polls/00000003")
    ingest.append_to(spark.readStream.format(polled.NAME).load(folder), target, checkpoint)
    assert sorted((bytes(r["content"]), r["poll"]) for r in spark.read.parquet(target).collect()) == [(b"a", 0), (b"b", 0), (b"c", 1)]
    polled._commit(make("d").withColumn("doc_id", F.sha2(F.lit(b"other"), 256)), folder)
    good, bad = polled.sound_and_damaged(spark.read.format(polled.NAME).load(folder))
    assert good.count() == 3 and [(r["error"], r["poll"]) for r in bad.collect()] == [("digest", 3)]


# ---- streams


def landed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)


def test_reconcile_never_deletes(spark):
    target = work_path(spark, "reconciled")
    schema = "id long, ts timestamp"
    make = lambda rows: spark.createDataFrame(rows, schema)
    now = lambda d: F.lit(d).cast("timestamp")
    ingest.reconcile(target, make([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))]), keys=["id"], order=["ts"], ts="ts", now=now("2024-01-03"))
    ingest.reconcile(target, make([(3, datetime(2024, 1, 20))]), keys=["id"], order=["ts"], ts="ts", now=now("2024-01-21"))
    ingest.reconcile(target, make([(3, datetime(2024, 1, 20)), (2, datetime(2024, 1, 2))]), keys=["id"], order=["ts"], ts="ts", now=now("2024-01-21"))
    found = ingest.read_target(spark, target, ingest.wider(spark.createDataFrame([], schema + ", mode string").schema))
    assert sorted((r["id"], r["batch"], r["mode"]) for r in found.collect()) == [(1, -1, "backfill"), (2, -1, "backfill"), (3, -2, "backfill")]


def test_many_small_batches_and_one_made_again(spark, monkeypatch):
    folder, target, checkpoint = (work_path(spark, x) for x in ("landing", "target", "checkpoint"))
    schema = "id long, ts timestamp, v string"
    for k in range(5):
        landed(spark, folder, [(i, datetime(2024, 1, 1 + i % 3), f"{i}-{k}") for i in range(k * 2, k * 2 + 6)], schema)
    stream = ingest.landing(spark, folder, spark.createDataFrame([], schema).schema, files=1)
    writes, real = [], ingest._write

    def twice(rows, *rest):
        writes.append(rest[1])
        real(rows, *rest)
        real(rows, *rest)  # as if the batch had failed after it wrote, and was tried again

    monkeypatch.setattr(ingest, "_write", twice)
    ingest.ingest(stream, target, checkpoint, keys=["id"], order=["ts"], ts="ts")
    found = ingest.read_target(spark, target, ingest.wider(spark.createDataFrame([], schema + ", mode string").schema))
    rows = found.collect()
    assert len(writes) >= 5 and sorted(r["id"] for r in rows) == list(range(14))
    assert all((r["mode"] == "catchup") == (r["batch"] == 0) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_hand_over_in_any_batches(spark, seed):
    r = random.Random(seed)
    zero = datetime(2024, 1, 1)
    filings = [(i, zero + timedelta(seconds=r.randrange(6000)), None if r.random() < 0.2 else i) for i in range(40)]
    facts = [(i, known + timedelta(seconds=r.randrange(-200, 1500))) for i, known, _ in filings if r.random() < 0.7]
    rows = [(i, t, s, "filing") for i, t, s in filings] + [(i, t, None, "facts") for i, t in facts] + [(filings[3][0], filings[3][1] + timedelta(seconds=50), 999, "filing")]
    rows = sorted(rows, key=lambda x: x[1]) + [(-1, zero + timedelta(days=1), None, "filing")]
    schema = "id long, at timestamp, security_id long, kind string"
    folder, target, checkpoint = (work_path(spark, x) for x in ("landing", "target", "checkpoint"))
    cuts = sorted(r.sample(range(1, len(rows)), 2))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        landed(spark, folder, rows[a:b], schema)
        stream = ingest.landing(spark, folder, spark.createDataFrame([], schema).schema)
        out = stateful.hand_over(stream.where("kind = 'filing'").withColumnRenamed("at", "known"), stream.where("kind = 'facts'").withColumnRenamed("at", "facts_at"), key="id", known="known", security="security_id", facts_at="facts_at")
        stateful.run_with_state(out, lambda s: ingest.append_to(s, target, checkpoint))
    want = ingest.handed_over(spark.createDataFrame(filings, "id long, known timestamp, security_id long"), spark.createDataFrame(facts, "id long, facts_at timestamp"), "id", "known", "facts_at").select("id", F.unix_micros("handed_at").alias("handed_us"), "outcome")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want.collect()))


def test_live_matching_in_batches(spark):
    r = random.Random(4)
    zero = datetime(2024, 1, 1)
    rows = sorted(((i, r.randrange(3), zero + timedelta(minutes=r.randrange(3000))) for i in range(60)), key=lambda x: x[2])
    schema = "id long, k long, ts timestamp"
    folder, target, checkpoint = (work_path(spark, x) for x in ("landing", "target", "checkpoint"))
    for a, b in ((0, 17), (17, 40), (40, 60)):
        landed(spark, folder, rows[a:b], schema)
        stream = ingest.landing(spark, folder, spark.createDataFrame([], schema).schema)
        stateful.match_live(stream.where("id % 2 = 0"), stream.where("id % 2 = 1"), target, checkpoint, by=["k"], ts="ts", key="id", max_gap_s=7200)
    pairs = sorted((abs(x[2] - y[2]), x[0], y[0]) for x in rows for y in rows if x[0] % 2 == 0 and y[0] % 2 == 1 and x[1] == y[1] and abs(x[2] - y[2]) <= timedelta(hours=2))
    partner = {}
    for _, x, y in pairs:
        if x not in partner and y not in partner:
            partner |= {x: y, y: x}
    found = {x["id"]: x["partner"] for x in stateful.partners(spark, target, "id").collect()}
    assert {k: v for k, v in found.items() if v is not None} == partner
    assert set(found) == {i for _, x, y in pairs for i in (x, y)}


def test_live_matching_does_no_work_for_nothing(spark):
    """State is cut into as many parts as are said, not the session's shuffle partitions, which stay as they are; a batch without candidates decides nothing."""
    zero = datetime(2024, 1, 1)
    rows = [(0, 1, zero), (1, 1, zero + timedelta(minutes=5)), (2, 2, zero + timedelta(days=1)), (3, 3, zero + timedelta(days=1))]
    schema = "id long, k long, ts timestamp"
    folder, target, checkpoint = (work_path(spark, x) for x in ("landing", "target", "checkpoint"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for part in (rows[:2], rows[2:]):
        landed(spark, folder, part, schema)
        stream = ingest.landing(spark, folder, spark.createDataFrame([], schema).schema)
        stateful.match_live(stream.where("id % 2 = 0"), stream.where("id % 2 = 1"), target, checkpoint, by=["k"], ts="ts", key="id", max_gap_s=7200, parts=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert len([x for x in ingest._folders(spark, f"{checkpoint}/state/0") if x.isdigit()]) == 3
    assert [x for x in ingest._folders(spark, f"{target}-nodes") if x.startswith("batch=")] == ["batch=0"]
    assert sorted(map(tuple, stateful.partners(spark, target, "id").collect())) == [(0, 1), (1, 0)]


# ---- studies, ordinary days, leaks


def test_daily_study_asks_each_table_once(spark, monkeypatch):
    folder = work_path(spark, "study-test")
    tables = {
        "filings": "filing_id long, event_type string, category string, available_at timestamp, security_id long", "names": "security_id long, symbol string, valid_from date, valid_to date", "prices": "symbol string, day date, open double, high double, low double, close double, prev_close double, turnover double",
        "bench": "day date, open double, close double", "actions": "symbol string, day date, multiplier double, review boolean", "cal": "day date, is_session boolean, is_special boolean, session_no int, open_ts timestamp, close_ts timestamp",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    plans = []
    real = studies.materialised
    monkeypatch.setattr(studies, "materialised", lambda df, name: (plans.append(df), real(df, name))[1])
    out = studies.daily_study(*(t[n] for n in ("filings", "names", "prices", "bench", "actions", "cal")), first="2024-01-01", last="2024-02-01", exits={"d0": 0, "d1": 1, "d5": 5}, excluded=["x"], lookback=20, least_turnover=1, least_price=1, most_gap=0.2, cooldown=5, round_trip=0.005)
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in (*plans, out)]
    assert sum(x.count("Exchange hashpartitioning") for x in texts) < 25
    assert sum(x.count(f"{folder}/prices".removeprefix("file:")) for x in texts) <= 1
    assert out.count() == 0


def test_no_price_no_quotient(spark):
    days = [("s", date(2024, 1, 1 + i), *x) for i, x in enumerate([(10.0, 11.0, 9.0, 10.5, 10.0, 50.0), (0.0, 11.0, 9.0, 10.5, 10.0, 50.0), (10.0, 11.0, 9.0, 10.5, 0.0, 50.0), (None, 1.0, 1.0, 1.0, 1.0, 0.0), (12.0, 13.0, 11.0, 12.5, 10.0, 50.0)])]
    prices = spark.createDataFrame(days, "symbol string, day date, open double, high double, low double, close double, prev_close double, turnover double")
    none = spark.createDataFrame([], "symbol string, day date, band double")
    found = studies.gap_days(prices, none.select("symbol", "day"), none.select("symbol", "band"), lookback=1, least_turnover=0, least_price=1, gap_edges=[0.02, 0.5], liquidity_edges=[0.0], band_margin=0.01)
    rows = {r["day"].day: r for r in found.collect()}
    assert [rows[d]["day_reason"] for d in range(1, 6)] == ["illiquid", "no_price", "no_price", "no_price", None]
    assert [rows[d]["gap"] is None for d in range(1, 6)] == [False, True, True, True, False] and rows[3]["short_gross"] is None and rows[3]["gap_bin"] == -1


def test_days_away_from_filings_and_evenly_apart(spark):
    r = random.Random(1)
    days = sorted({(r.choice("ab"), r.randrange(60)) for _ in range(70)})
    filed = [(r.choice("ab"), r.randrange(60)) for _ in range(6)]
    far = [d for d in days if all(d[0] != f[0] or abs(d[1] - f[1]) >= 3 for f in filed)]
    rows = spark.createDataFrame(days, "k string, p int")
    found = reaction.away_from(rows, spark.createDataFrame(filed, "k string, p int"), by=["k"], place="p", least=3)
    assert sorted(map(tuple, found.collect())) == far
    drawn = sorted(map(tuple, reaction.evenly(found, by=["k"], place="p", n=5, offset=F.lit(3)).collect()))
    for k in "ab":
        own = [d for d in far if d[0] == k]
        picked = [own.index(d) for d in drawn if d[0] == k]
        assert len(picked) == min(5, len(own)) and all(len(own) // 5 <= b - a <= len(own) // 5 + 1 for a, b in zip(picked, picked[1:], strict=False))


def test_only_what_comes_after_is_changed(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i), float(i), f"s{i}", i, i % 2 == 0, None) for i in range(6)], "id int, at timestamp, x double, s string, n int, f boolean, z string")
    found = {r["id"]: r for r in leaks.perturbed(rows, "at", F.lit("2024-01-03").cast("timestamp"), keep=["id"]).collect()}
    for r in rows.collect():
        same = r["id"] <= 2
        assert (found[r["id"]] == r) == same
        if not same:
            assert all(found[r["id"]][c] != r[c] for c in ("x", "s", "n", "f")) and found[r["id"]]["at"] == r["at"] and found[r["id"]]["z"] is None
