"""Repeated spans, repair of conversations, ranked search, and tool calls across conversations, each against a plain version."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, rows_of, rows_of_sql
from pyspark.sql import functions as F

from epochlens.llm import chat_tools, conversation_repair, ranked_search, substring_dedup
from epochlens.llm.common import table

CLASHING = ["doc", "rid", "start", "anchor", "owner", "links", "kind", "id", "rank", "score", "query", "fault", "place"]


def widened(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


# ---- repeated spans


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_equal_all_substrings(seed):
    r = random.Random(seed)
    runs = [[b"%d" % r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(3)]
    one = substring_dedup.Automaton()
    for run in runs:
        one.add(run)
    held = {tuple(run[a:b]) for run in runs for a in range(len(run)) for b in range(a + 1, len(run) + 1)}
    asked = [b"%d" % r.randrange(4) for _ in range(80)]
    want = [max((n for n in range(e + 2) if n == 0 or tuple(asked[e + 1 - n : e + 1]) in held), default=0) for e in range(len(asked))]
    assert list(one.matches(asked)) == want


def plain_removal(rows, n):
    """rows: (doc_id, text); a null id is the greatest."""
    words = [(math.inf if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in words:
        for s in range(len(ws) - n + 1):
            key = tuple(ws[s : s + n])
            first[key] = min(i, first.get(key, math.inf))
    out = []
    for (i, ws), (doc, _) in zip(words, rows, strict=True):
        gone = {s + k for s in range(len(ws) - n + 1) if first[tuple(ws[s : s + n])] < i for k in range(n)}
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def texts_with_copies(r, n):
    words = [f"w{k}" for k in range(9)] + ["é", "日本"]
    rows = []
    for i in range(n):
        ws = [r.choice(words) for _ in range(r.randrange(0, 40))]
        if rows and r.random() < 0.5:
            other = (r.choice(rows)[1] or "").split()
            a = r.randrange(len(other) + 1)
            at = r.randrange(len(ws) + 1)
            ws[at:at] = other[a : a + r.randrange(15)]
        rows.append((i, r.choice([" ", "\n", "\t  "]).join(ws)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_removal_equals_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "PER_PART", 2)
    r = random.Random(seed)
    rows = texts_with_copies(r, 40)
    rows += [(3, rows[9][1]), rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1]), (90, None), (91, ""), (92, " \n "), (-4, rows[8][1]), (95, rows[2][1] + " " + rows[3][1])]
    r.shuffle(rows)
    df = widened(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    found = substring_dedup.remove_repeats(df, 5, 2, texts=True)
    assert sorted(map(repr, map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()))) == sorted(map(repr, plain_removal(rows, 5)))


def test_removal_of_a_long_text_and_of_nothing(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long + " y")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert found == {1: (30_000, 0), 2: (30_002, 30_000)}
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0


def test_removal_equals_sql(spark):
    assert rows_of(substring_dedup.op11_substring_dedup(spark, SMALL)) == rows_of_sql(substring_dedup.OP11_SQL, SMALL)


def test_known_reference_in_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "SHARDS", 2)
    r = random.Random(3)
    rows = texts_with_copies(r, 20)
    known = [t for _, t in rows[:12]] + [None, ""]
    held = {tuple(t.split()[a : a + 5]) for t in known if t for a in range(len(t.split()) - 4)}
    docs = [(100 + i, t) for i, t in rows] + [(7, None)]
    found = substring_dedup.remove_known(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string"), 5)
    got = {r["doc_id"]: r["n_removed"] for r in found.collect()}
    for i, t in docs:
        ws = (t or "").split()
        assert got[i] == len({a + k for a in range(len(ws) - 4) if tuple(ws[a : a + 5]) in held for k in range(5)})


# ---- repair of conversations


def enumerated(rows):
    """Least (cost, audit) over all edits, by trying every sequence with at most len(rows) + 2 insertions."""
    best = None

    def go(at, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        s = "".join(roles)
        body = s[1:] if s[:1] == "s" else s
        if s[1:].count("s") or any(x != "ua"[k % 2] for k, x in enumerate(body)):
            return
        if at == len(rows) and (not s or (body and len(body) % 2 == 0)):
            best = min(x for x in (best, (cost, audit, tuple(roles))) if x is not None)
        if inserted < len(rows) + 2:
            for x in "ua":
                go(at, [*roles, x], cost + 3, audit + "I", inserted + 1)
        if at < len(rows):
            role, must, truncated = rows[at]
            go(at + 1, roles, cost + 4, audit + "D", inserted)
            if not must:
                more = 3 if truncated else 0
                if role[:1] in ("s", "u", "a"):
                    go(at + 1, [*roles, role[:1]], cost + more, audit + "K", inserted)
                for x in "ua":
                    go(at + 1, [*roles, x], cost + 3 + more, audit + "R", inserted)

    go(0, [], 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_search_equals_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "system", " ", "tool"]), f"t{k}", r.random() < 0.25, r.random() < 0.3) for k in range(r.randrange(0, 5))]
    one = conversation_repair.Repair(False)
    for row in rows:
        one.add(row)
    cost, audit, digest, _ = one.end()
    want = enumerated([(role, must, truncated) for role, _, must, truncated in rows])
    assert (cost, audit) == want[:2]
    given = list(conversation_repair.replay(rows, audit, conversation_repair.START))
    assert "".join(role[:1] for role, _ in given) == "".join(want[2])
    assert digest == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in given).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_segments_change_nothing(monkeypatch, seed):
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "assistant", "system", "x"]), f"t{k}", r.random() < 0.2, r.random() < 0.3) for k in range(60)]
    found = []
    for size in (1, 7, 1000):
        monkeypatch.setattr(conversation_repair, "SEGMENT", size)
        one = conversation_repair.Repair(True)
        for row in rows:
            one.add(row)
        found.append(one.end())
    assert found[0] == found[1] == found[2]


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, 0, None, None), (None, None, "user", "A?"), (2, 5, "user", " \n"), (2, 5, "user", " \n"), (3, 9, "assistant", "same."), (3, 2, "assistant", "same."), (4, 1, "user", "cut off"), (5, 1, "user", "x. "), (6, None, "user", "n.")]
    df = widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r for r in conversation_repair.repair(df, texts=True).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, None}
    assert (found[1]["cost"], found[1]["audit"], found[1]["repaired"]) == (0, "KK", "user:Hi.\nassistant:Yes.")
    assert (found[None]["blank"], found[None]["gaps"], found[None]["audit"]) == (1, 0, "KDI")  # the null turn comes first
    assert (found[2]["blank"], found[2]["duplicate"], found[2]["audit"], found[2]["repaired"]) == (2, 0, "DD", "")
    assert (found[3]["duplicate"], found[3]["gaps"], found[3]["cost"]) == (1, 6, 7)
    assert (found[4]["truncated"], found[4]["cost"], found[4]["audit"]) == (1, 4, "D")
    assert found[5]["truncated"] == 1 and found[6]["gaps"] == 0
    gone = spark.createDataFrame([(7, 1, "user", "x.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    (row,) = conversation_repair.repair(gone).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.repair(df.where("false")).count() == 0


def test_repair_equals_sql(spark):
    assert rows_of(conversation_repair.op12_conversation_repair(spark, SMALL)) == rows_of_sql(conversation_repair.OP12_SQL, SMALL)


# ---- ranked search


def plain_ranking(docs, items, k):
    cut = [(i, ranked_search.terms((t or "").encode())) for i, t in docs]
    cut = [(i, ws) for i, ws in cut if ws]
    n, total, df = len(cut), sum(len(ws) for _, ws in cut), Counter(w for _, ws in cut for w in set(ws))
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, ws in cut:
            m, tf = 75 + (25 * len(ws) * n) // total, Counter(ws)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in ranked_search.terms((text or "").encode()) if tf[w])
            if score > 0:
                found.append((-score, math.inf if i is None else i, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 20), (25, 30), (1, 1)])
def test_ranking_equals_all_scores(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    r = random.Random(shard)
    words = [f"w{k}" for k in range(25)] + ["É", "é", "x1"]
    docs = [(i, r.choice([" ", "-", "_"]).join(r.choices(words, k=r.randrange(0, 30)))) for i in range(60)]
    docs += [(60, docs[3][1]), (61, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (62, None), (63, ""), (64, "?!"), (65, "W1 w1 W1"), (66, "long " * 3000 + "w2")]
    items = [(1, "w1 w2 w3 w1"), (2, docs[3][1]), (3, "nowhere"), (4, None), (5, "w1"), (5, "w1"), (5, "w2 É")]
    found = ranked_search.search(widened(spark.createDataFrame(docs, "doc_id long, text string")).repartition(4), widened(spark.createDataFrame(items, "item_id long, text string")), 7)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_ranking(docs, items, 7)))
    assert found.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_ranking_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0


def test_ranking_equals_sql(spark):
    assert rows_of(ranked_search.op13_ranked_search(spark, SMALL)) == rows_of_sql(ranked_search.OP13_SQL, SMALL)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_the_best_cut(monkeypatch, seed):
    monkeypatch.setattr(ranked_search, "LONGEST", 5)
    r = np.random.default_rng(seed)
    lists = [r.integers(1, 50, n) for n in (1, 9, 4, 12)]
    parts, starts = np.concatenate(lists).astype(np.int64), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    blocks, first = ranked_search.cut_blocks(parts, starts)
    assert blocks[-1] == len(parts)
    for i, own in enumerate(lists):
        price = max(1, ranked_search.PRICE * int(own.sum()) // len(own))
        cost = lambda cuts, own=own, price=price: sum((b - a) * int(own[a:b].max()) + price for a, b in itertools.pairwise(cuts))
        cuts = [int(x) - int(starts[i]) for x in blocks[first[i] : first[i + 1]]] + [len(own)]
        least = min(cost([0, *c, len(own)]) for n in range(len(own)) for c in itertools.combinations(range(1, len(own)), n) if all(b - a <= 5 for a, b in itertools.pairwise([0, *c, len(own)])))
        assert cuts[0] == 0 and all(b - a <= 5 for a, b in itertools.pairwise(cuts)) and cost(cuts) == least


def test_most_documents_are_skipped():
    r = np.random.default_rng(1)
    docs, terms, n, held = [], [], 20_000, [20, 60, 200, 700, 2000, 9000]
    for t, size in enumerate(held):
        own = np.sort(r.choice(n, size, replace=False))
        docs.append(np.repeat(own, r.integers(1, 9, len(own))))
        terms.append(np.full(len(docs[-1]), t))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in held])
    shard = ranked_search.Shard(np.arange(n), np.full(n, 200), np.concatenate(docs), np.concatenate(terms), weights, n, 200 * n)
    scores, ids = shard.best([(t, 1) for t in range(6)], 20, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    whole = np.zeros(n, np.int64)
    for i in range(6):
        a, b = shard.starts[i], shard.starts[i + 1]
        whole[shard.at[a:b]] += shard.parts[a:b]
    want = heapq.nlargest(20, ((s, -i) for i, s in enumerate(whole.tolist())))
    assert list(zip(scores.tolist(), (-ids).tolist(), strict=True)) == want
    assert 20 <= shard.looked < n / 20


# ---- tool calls


def plain_levels(calls):
    after = defaultdict(set)
    for c, i, a in calls:
        if i is not None:
            after[c, i] |= {(c, x) for x in a or ()}
    after = {k: {p for p in v if p in after and p != k} for k, v in after.items()}
    level = {}
    while ready := [k for k, v in after.items() if k not in level and v <= level.keys()]:
        level |= {k: 1 + max((level[p] for p in after[k]), default=-1) for k in ready}
    return {k: level.get(k) for k in after}


@pytest.mark.parametrize("seed", range(2))
def test_levels_are_longest_ways(spark, seed):
    r = random.Random(seed)
    calls = []
    for c in ("chain", "tree", "any"):
        for i in range(14):
            a = [f"k{i - 1}"] if c == "chain" and i else [f"k{r.randrange(i or 1)}" for _ in range(r.choice([0, 1, 2]))] if c == "tree" else [f"k{r.randrange(14)}" for _ in range(r.choice([0, 1, 1, 2]))]
            calls.append((c, f"k{i}", [*a, "nowhere"] if r.random() < 0.2 else a))
    calls += [("chain", "k13", ["k2"]), ("chain", None, ["k1"]), ("none", "k0", None)]
    found = chat_tools.levels(spark.createDataFrame(calls, "c string, call_id string, after array<string>"))
    assert {(x["c"], x["call_id"]): x["level"] for x in found.collect()} == plain_levels(calls)


def test_calls_of_several_conversations_stay_apart(spark):
    calls = [(1, "a", None, 0, "reply", "{}"), (2, "a", None, 0, "reply", "{}"), (2, "b", "a", 2, "reply", "{}"), (3, "b", "a", 0, "reply", "{}"), (None, "a", None, 0, "reply", "{}")]
    results = [(1, "a", 1, "first"), (2, "a", 1, "second"), (4, "a", 1, "lone"), (None, "a", 3, "nobody's"), (None, None, 1, "no id")]
    schema = "conv_id long, call_id string, after string, turn long, name string, arguments string"
    linked = chat_tools.link_tool_calls(spark.createDataFrame(calls, schema), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), chat_tools.REPLY)
    found = {(r["conv_id"], r["call_id"], r["status"]): (r["level"], r["canonical"].partition('"result":')[2].rstrip("}")) for r in linked.collect()}
    assert found == {(1, "a", "linked"): (0, '"first"'), (2, "a", "linked"): (0, '"second"'), (2, "b", "unanswered"): (1, ""), (3, "b", "unanswered"): (0, ""), (None, "a", "linked"): (0, '"nobody\'s"'), (4, "a", "orphan"): (None, '"lone"'), (None, None, "orphan"): (None, '"no id"')}


def test_tool_calls_equal_sql_where_ids_repeat(spark):
    ids = table(spark, SMALL, "conversations").select("conv_id", "turn").where("role = 'user'").groupBy("turn").agg(F.countDistinct("conv_id").alias("n"))
    assert ids.agg(F.max("n")).first()[0] > 1  # one identifier in several conversations
    assert rows_of(chat_tools.op6_chat_tools(spark, SMALL)) == rows_of_sql(chat_tools.OP6_SQL, SMALL)
