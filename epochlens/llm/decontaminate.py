"""Benchmark decontamination by a random-walk embedding.

A document is contaminated if a stretch of it is within ``ERROR_RATE`` of an item's words in word edit distance. Candidates come from the
CGK embedding: a walk over a window writes down the word under its pointer at each step, and a random bit of the word and the step tells
whether the pointer moves on, so that windows of small edit distance get outputs of small Hamming distance. Several tables, each
sampling a few steps, of several independent walks hash these outputs; windows that share a key with an item are aligned to it exactly.

Windows are of the items' sizes: items are grouped into classes by length, a class's windows are half as long as its shortest item and start
at every ``stride``-th word of a document, and an item is entered at every place, so that one of its windows always starts where a document's does.

Copies without edits are always found, as equal windows have equal keys. For copies with edits walks are repeated, for each class of items, until the odds
of finding one at ``ERROR_RATE``, measured on random items, are ``TARGET_RECALL``.

Items are sent to the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, one pass over the documents for each block.

Defined results: words are runs of letters, digits and non-ASCII characters, in lower case; null, empty and blank texts match nothing; items without a
word match nothing; repeated items each match, repeated rows give equal rows; a document shorter than an item can match it within the error rate; an empty benchmark
leaves all documents clean; texts of any length are handled whole; further columns stay as they are.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import materialised, series_slices, table
from epochlens.llm.ngrams import Tokens, mixed

ERROR_RATE = 0.2
#: Tables of a walk, and steps that each samples. Walks are repeated until the odds of finding a copy at ERROR_RATE are TARGET_RECALL.
TABLES, SAMPLED = 6, 4
TARGET_RECALL, TRIALS, MOST_WALKS = 0.95, 200, 24
BLOCK_ITEMS, BLOCK_WORDS = 5_000, 2_000_000
SEED = 99
#: Steps of a walk for each word of a window: its pointer moves on at every second step, and so stays within the window.
STEPS_PER_WORD = 1.4
#: Lengths of one class differ by this factor at most.
CLASS_FACTOR = 1.4
_PAD = np.uint64(0x5851F42D4C957F2D)
MATCHES = "array<struct<item:bigint,start:int,end:int,distance:int>>"


def folded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.lower().encode() for t in texts]


def walk_keys(words: np.ndarray, starts: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """tables x windows: the keys of the windows under one walk. words ends with so many padding words that no walk leaves it."""
    rng = np.random.default_rng([SEED, walk])
    turns = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled = np.random.default_rng([SEED, walk, steps])
    tables_of = defaultdict(list)
    for t in range(TABLES):
        for step in sampled.choice(steps, min(SAMPLED, steps), replace=False):
            tables_of[int(step)].append(t)
    at = starts.astype(np.int64)
    keys = np.zeros((TABLES, len(starts)), np.uint64)
    last = max(tables_of)
    for j in range(last + 1):
        word = words[at]
        for t in tables_of.get(j, ()):
            keys[t] *= np.uint64(0xD1342543DE82EF95)
            keys[t] += word + np.uint64(j + 1)
        if j < last:
            word *= turns[j]
            word >>= np.uint64(63)
            at += word.view(np.int64)
    return mixed(keys)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words after so many insertions, deletions and replacements at random places."""
    out = words.tolist()
    for _ in range(edits):
        at, new = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 1 << 62))
        kind = rng.integers(0, 3)
        if kind == 0 or not out:
            out.insert(at, new)
        else:
            out[min(at, len(out) - 1) : min(at, len(out) - 1) + 1] = [new] if kind == 1 else []
    return np.array(out, np.uint64)


def shape_of(least: int) -> tuple[int, int, int]:
    """Stride, size of a window and steps of its walk, for items of at least so many words."""
    stride = max(1, least // 4)
    size = max(min(3, least), least // 2)
    return stride, size, max(1, int(STEPS_PER_WORD * size))


@functools.cache
def walks_for(least: int) -> int:
    """Walks that items of at least so many words need to be found at ERROR_RATE with odds of TARGET_RECALL.

    Measured: TRIALS random items are edited as far as ERROR_RATE allows and stand at random places; walks are added until so many are met.
    """
    stride, size, steps = shape_of(least)
    rng = np.random.default_rng([SEED, least])
    left = []
    for _ in range(TRIALS):
        item = rng.integers(0, 1 << 62, least, dtype=np.uint64)
        copy = edited(item, int(ERROR_RATE * least), rng)
        text = np.concatenate([rng.integers(0, 1 << 62, int(rng.integers(0, stride)), dtype=np.uint64), copy, rng.integers(0, 1 << 62, stride, dtype=np.uint64)])
        pad = np.full(2 * size, _PAD)
        left.append((np.concatenate([item, pad]), np.arange(max(1, least - size + 1)), np.concatenate([text, pad]), np.arange(0, max(1, len(text)), stride)))
    for walk in range(MOST_WALKS):
        left = [x for x in left if not any(np.intersect1d(a, b).size for a, b in zip(walk_keys(x[0], x[1], steps, walk), walk_keys(x[2], x[3], steps, walk), strict=True))]
        if len(left) <= (1 - TARGET_RECALL) * TRIALS:
            return walk + 1
    return MOST_WALKS


class Index:
    """Keys of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        t = Tokens(folded(texts), fold=True, marks=False)
        self.ids = ids
        self.words = [t.hash[a:b] for a, b in zip(t.first, t.first[1:], strict=False)]
        self.distinct = [frozenset(w.tolist()) for w in self.words]
        self.classes: list[dict] = []
        by_class: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                by_class[int(np.log(len(w)) / np.log(CLASS_FACTOR) + 1e-9)].append(k)
        for members in by_class.values():
            least = min(len(self.words[k]) for k in members)
            stride, size, steps = shape_of(least)
            starts, flat, owner, at = [], [], [], 0
            for k in members:
                w = self.words[k]
                for shift in range(len(w) - size + 1):  # every window of the item, as the copy may be clean in any part
                    starts.append(at + shift)
                    owner.append((k, shift))
                flat += [w, np.full(2 * size, _PAD)]
                at += len(w) + 2 * size
            words = np.concatenate(flat)
            bits = int(np.ceil(np.log2(len(owner)))) + 6
            c = {"stride": stride, "size": size, "steps": steps, "walks": walks_for(least), "mask": np.uint64((1 << bits) - 1), "owner": owner, "tables": []}
            for walk in range(c["walks"]):
                for keys in walk_keys(words, np.array(starts), steps, walk):
                    order = np.argsort(keys, kind="stable")
                    seen = np.zeros(1 << bits, bool)
                    seen[(keys & c["mask"]).astype(np.int64)] = True
                    c["tables"].append((keys[order], order, seen))
            self.classes.append(c)

    def candidates(self, t: Tokens) -> set[tuple[int, int, int]]:
        """(text, item, about where it starts in the text's words)."""
        found: set[tuple[int, int, int]] = set()
        counts = np.diff(t.first)
        words = np.concatenate([t.hash, np.full(2 * max((c["size"] for c in self.classes), default=1), _PAD)])
        for c in self.classes:
            # a window may reach into the next text, where an edited copy ends before it does
            per_text = -(-counts // c["stride"])
            text = np.repeat(np.arange(len(counts)), per_text)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            starts = t.first[:-1][text] + nth * c["stride"]
            for walk in range(c["walks"]):
                for keys, (known, order, seen) in zip(walk_keys(words, starts, c["steps"], walk), c["tables"][walk * TABLES : (walk + 1) * TABLES], strict=True):
                    hit = np.flatnonzero(seen[(keys & c["mask"]).astype(np.int64)])
                    lo, hi = np.searchsorted(known, keys[hit], "left"), np.searchsorted(known, keys[hit], "right")
                    for h, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                        for o in order[a:b]:
                            k, shift = c["owner"][o]
                            found.add((int(text[h]), k, int(starts[h] - t.first[text[h]]) - shift))
        return found

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that it holds: item, start and end among its words, distance; the best place of each item, the first of equals."""
        sources = folded(texts)
        t = Tokens(sources, fold=True, marks=False)
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for (text, k), places in itertools.groupby(sorted(self.candidates(t)), key=lambda c: c[:2]):
            item = self.words[k]
            most = int(ERROR_RATE * len(item))
            words = t.hash[t.first[text] : t.first[text + 1]]
            for first, last in stretches([at for _, _, at in places], most):
                lo, hi = max(0, first - most - 1), min(len(words), last + len(item) + most + 1)
                if len(self.distinct[k].difference(words[lo:hi].tolist())) > most:  # each word that isn't there costs an edit
                    continue
                distance, a, b = aligned(item, words[lo:hi])
                if distance <= most and (k not in best[text] or distance < best[text][k][0]):
                    best[text][k] = (distance, lo + a, lo + b)
        return [sorted(({"item": self.ids[k], "start": a, "end": b, "distance": d} for k, (d, a, b) in found.items()), key=lambda m: (m["item"], m["start"])) for found in best]


def stretches(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of the sorted places that follow each other within the gap, which are aligned together."""
    first = last = places[0]
    for at in places[1:]:
        if at - last > max(1, gap):
            yield first, last
            first = at
        last = at
    yield first, last


def aligned(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of words that is nearest to the item in edit distance: exact, row by row."""
    n = len(words)
    row, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, w in enumerate(item, 1):
        across = np.concatenate([[k], row[:-1] + (words != w)])
        down = row + 1
        take = across <= down
        new, start = np.where(take, across, down), np.where(take, np.concatenate([[0], came[:-1]]), came)
        # insertions from the left: the running minimum of value - place
        low = np.minimum.accumulate(new - steps)
        where = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        row, came = low + steps, start[where]
    end = int(row.argmin())
    return int(row[end]), int(came[end]), end


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """One index after the other, each for a block of items that is bounded in items and words."""
    plain = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    size = plain.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // (4 * BLOCK_WORDS)))
    for b in range(blocks):
        if rows := plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect():
            yield Index([r["id"] for r in rows], [r["text"] for r in rows])


def with_matches(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", out_col: str = "matches") -> DataFrame:
    """docs with one more column, the array of (item, start, end, distance) that each text holds; start and end count words.

    A block's index is sent out and gone before the next one is made; with several blocks docs are written down after each.
    """

    def column(shared: Broadcast) -> Column:
        @F.pandas_udf(MATCHES)
        def find(text: pd.Series) -> pd.Series:
            found: list[list[dict]] = []
            for some in series_slices(text):
                found += shared.value.matches(some)
            return pd.Series(found, dtype=object)

        return find(F.col(text_col).cast("string"))

    out, sent = docs.withColumn(out_col, F.array().cast(MATCHES)), None
    for index in item_blocks(items, item_id_col, item_text_col):
        if sent is not None:
            out = materialised(out, "matches")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(index)
        out = out.withColumn(out_col, F.concat(out_col, column(sent)))
    return out


def clean(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """The rows of docs whose text holds no item, with docs' columns."""
    name = "_matches"
    while name in docs.columns:
        name += "_"
    found = with_matches(docs, items, out_col=name, **names)
    return found.where(F.coalesce(F.size(name), F.lit(0)) <= 0).drop(name)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.transform("matches", lambda m: m["item"])
    return found.select("doc_id", (F.coalesce(F.size("matches"), F.lit(0)) > 0).alias("contaminated"), F.coalesce(items, F.array().cast("array<bigint>")).alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("distance"))
