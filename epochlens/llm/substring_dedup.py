"""Removal of long repeated word sequences by matching statistics over suffix automata of reference shards.

The corpus is its own reference: a word goes if it lies in a window of n words that a document with a smaller doc_id holds too. No bound on the whole reference can be
proven, so that it isn't sent to all tasks; an automaton is sent to where the documents are that could match it:

1. Anchors. Each window names its smallest k-gram (by hash) as its anchor; equal windows name equal anchors, and neighbours mostly share theirs (a fifth of all places). An anchor's owner is the smallest
   document that has it (partial aggregation, then a join that Spark may split).
2. Shards. An owner's stretches around its own anchors are a reference shard; other documents' stretches go to the shards of their anchors' owners. An anchor that many documents have
   has its shard sent to one task for each ``PER_PART`` of its occurrences.
3. Matching. A task builds one shard's suffix automaton after the other and streams stretches through it: where the match is n words long or longer, the window goes.
4. Windows that share an anchor with an owner which doesn't hold the window are undecided. They go through the same steps once more, with the whole window as its anchor. The first
   document that has such a window is undecided there as well, so that it is found then.

``remove_known`` is the same against a reference table of a checked size: its shards' automata are broadcast and documents pass by them once a round.

Words are compared as bytes. Hashes (64 bits) only lead to shards: unlike words are never taken for equal, and a window is lost only if two windows that are both undecided have one hash.

Defined results: a null text has no words; rows of one doc_id, and rows without one, never take words from each other (a null doc_id counts as the greatest); repeated rows give a row each; texts of fewer
than n words stay whole; repeats within one document stay; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import materialised, slices, table

#: Words of a window, and of the anchor that windows are led by first.
WINDOW, ANCHOR = 13, 5
#: Occurrences of an anchor for each copy of its shard.
PER_PART = 4096
#: Words of the reference of one broadcast automaton, and automata of one pass over the documents.
SHARD_WORDS, SHARDS = 200_000, 8
#: Bytes whose polynomials are summed at once, and rows of a batch that is given back.
SUMMED, ROWS = 1 << 20, 100_000
NO_ID = np.iinfo(np.int64).max


class Automaton:
    """Suffix automaton over sequences of words; a sequence never goes on in the next one."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the sequences of q that p leads to; a copy of q for the shorter ones if q has longer ones as well."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        nexts, links, lengths = self.next, self.link, self.length
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None:
                last = self._split(last, known, word)
                continue
            new = self._state(lengths[last] + 1, 0, {})
            p = last
            while p != -1 and word not in nexts[p]:
                nexts[p][word] = new
                p = links[p]
            if p != -1:
                links[new] = self._split(p, nexts[p][word], word)
            last = new

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """At each word the length of the longest sequence ending there that was added."""
        nexts, links, lengths = self.next, self.link, self.length
        state = length = 0
        for word in words:
            after = nexts[state].get(word)
            while after is None and state:
                state = links[state]
                length = lengths[state]
                after = nexts[state].get(word)
            if after is None:
                length = 0
            else:
                state, length = after, length + 1
            yield length


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Where the words of a column of texts are, and their hashes: all rows at once. row: the row of each word; starts, ends: its bytes in data."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.binary()), b"").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        word = ~_SPACE[self.data]
        first = np.zeros(len(word) + 1, bool)  # a word ends with its row
        first[self.offsets[:-1]] = True
        first[-1] = True
        before, behind = np.append(False, word[:-1]), np.append(word[1:], False)
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        self.ends = np.flatnonzero(word & (~behind | first[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1

    def hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, by sums of prefixes of some bytes at a time."""
        out = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SUMMED, "right")))
            low, high = int(self.starts[i]), int(self.ends[j - 1])
            power, inverse = _powers(high - low)
            sums = np.append(np.uint64(0), np.cumsum(self.data[low:high].astype(np.uint64) * power[: high - low]))
            out[i:j] = (sums[self.ends[i:j] - low] - sums[self.starts[i:j] - low]) * inverse[self.starts[i:j] - low]
            i = j
        return _mixed(out)

    def text(self, first: int, last: int) -> bytes:
        """The words from first to before last, with what is between them."""
        return self.data[self.starts[first] : self.ends[last - 1]].tobytes()


def anchors(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word that begins a window inside its row the least hash of the window's k-grams, and whether one begins there."""
    n = len(words.row)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    one = words.hashes()
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(_BASE) + one[j : n - k + 1 + j]
    least, span, width = _mixed(gram), 1, window - k + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return least.view(np.int64), words.row[: n - window + 1] == words.row[window - 1 :]


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _anchor_rows(batches, k: int, window: int, whole: bool):
    """Stretches (doc, rid, start, text) to their distinct anchors: anchor, doc and, if whole, rid and start."""
    names = ["doc", "rid", "start"] if whole else ["doc"]
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            least, inside = anchors(words, k, window)
            value, row = least[inside], words.row[: len(least)][inside]
            if len(value):
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                fresh = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))
                value, row = value[fresh], row[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), *(part.column(n).take(pa.array(row)) for n in names)], names=["anchor", *names])


_CUT = pa.schema([("kind", pa.string()), ("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("owner", pa.int64()), ("parts", pa.int64()), ("salt", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])
_CUT_DDL = "kind string, doc long, rid long, start long, owner long, parts long, salt long, text binary, doc_id long, n_words long, kept_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(batches, k: int, window: int, whole: bool):
    """Stretches with their links (anchor, owner, parts), to stretches of reference (kind ref) and stretches to be matched (kind ask). whole: they are documents, of which those without links are done (kind done), others are kept (kind text)."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            least, _ = anchors(words, k, window)
            own = [part.column(n).to_pylist() for n in ("doc", "rid", "start", "doc_id" if whole else "doc")]
            links, texts = part.column("links"), _bytes(part.column("text")) if whole else None
            borders = np.searchsorted(words.row, np.arange(part.num_rows + 1))
            for r, (doc, rid, start, doc_id) in enumerate(zip(*own, strict=True)):
                low, high = int(borders[r]), int(borders[r + 1])
                if not links[r].is_valid:
                    if whole:
                        kept = hashlib.sha256(b" ".join((texts[r] or b"").split())).hexdigest()
                        rows.append(("done", doc, rid, None, None, None, None, None, doc_id, high - low, kept))
                    continue
                if whole:
                    rows.append(("text", doc, rid, None, None, None, None, texts[r], doc_id, None, None))
                    size += len(texts[r])
                led = links[r].values
                anchor, owner, parts = (led.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "owner", "parts"))
                order = np.argsort(anchor)
                at = np.minimum(np.searchsorted(anchor[order], least[low : high - window + 1]), len(anchor) - 1)
                link = order[at]
                known = anchor[link] == least[low : high - window + 1]
                change = np.append(True, (known[1:] != known[:-1]) | (known[1:] & ((owner[link[1:]] != owner[link[:-1]]) | (parts[link[1:]] != parts[link[:-1]]))))
                runs = np.append(np.flatnonzero(change), len(known)).tolist()
                for i, j in zip(runs, runs[1:], strict=False):
                    if not known[i]:
                        continue
                    of, n = int(owner[link[i]]), int(parts[link[i]])
                    stretch = words.text(low + i, low + j + window - 1)
                    size += len(stretch)
                    if of == doc:
                        rows += [("ref", doc, rid, start + i, of, n, s, stretch, None, None, None) for s in range(n)]
                    else:
                        rows.append(("ask", doc, rid, start + i, of, n, (doc ^ rid) % n, stretch, None, None, None))
            if size > 4 << 20 or len(rows) > ROWS:
                yield _batch(rows, _CUT)
                rows, size = [], 0
    yield _batch(rows, _CUT)


_MATCHED = pa.schema([("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("text", pa.binary())])


def spans(found: list[bool], window: int) -> Iterator[tuple[int, int, bool]]:
    """Maximal runs of windows that are alike: first word, number of words, whether they are found."""
    i = 0
    while i < len(found):
        j = i + 1
        while j < len(found) and found[j] == found[i]:
            j += 1
        yield i, j - i + window - 1, found[i]
        i = j


def _match(batches, window: int):
    """Rows sorted by shard, its reference first, to spans: those to be removed have no text, undecided ones have theirs."""
    key, automaton, rows = None, Automaton(), []
    for batch in batches:
        for part in slices(batch):
            columns = [part.column(n).to_pylist() for n in ("owner", "parts", "salt", "kind", "doc", "rid", "start", "text")]
            for owner, parts, salt, kind, doc, rid, start, text in zip(*columns, strict=True):
                if (owner, parts, salt) != key:
                    key, automaton = (owner, parts, salt), Automaton()
                words = text.split()
                if kind == "ref":
                    automaton.add(words)
                    continue
                found = [n >= window for n in automaton.matches(words)][window - 1 :]
                for first, n, known in spans(found, window):
                    rows.append((doc, rid, start + first, n, None if known else b" ".join(words[first : first + n])))
            if len(rows) >= 4096:
                yield _batch(rows, _MATCHED)
                rows = []
    yield _batch(rows, _MATCHED)


def _released(df: DataFrame) -> DataFrame:
    """df, after Spark's cleaner was called for: what finished plans have shuffled stays on the executors' disks until the driver happens to collect its garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _round(stretches: DataFrame, k: int, window: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """What _cut gives of the stretches, and of these what _match gives."""
    mapped = lambda all_of_it, ddl: stretches.select("doc", "rid", "start", "text").mapInArrow(lambda b: _anchor_rows(b, k, window, all_of_it), ddl)
    seen = mapped(False, "anchor long, doc long").groupBy("anchor").agg(F.min("doc").alias("owner"), F.count("*").alias("n"))
    shared = _released(materialised(seen.where("n > 1").select("anchor", "owner", (1 + F.floor(F.col("n") / PER_PART)).alias("parts")), "anchors"))
    found = mapped(True, "anchor long, doc long, rid long, start long").join(shared, "anchor")
    links = _released(materialised(found.groupBy("doc", "rid", "start").agg(F.collect_list(F.struct("anchor", "owner", "parts")).alias("links")), "links"))
    led = stretches.join(links, ["doc", "rid", "start"], "left" if whole else "inner")
    cut = _released(materialised(led.mapInArrow(lambda b: _cut(b, k, window, whole), _CUT_DDL), "stretches"))
    to_match = cut.where("kind in ('ref', 'ask')").select("owner", "parts", "salt", "kind", "doc", "rid", "start", "text")
    dealt = to_match.repartition("owner", "parts", "salt").sortWithinPartitions("owner", "parts", "salt", F.desc("kind"))
    return cut, _released(materialised(dealt.mapInArrow(lambda b: _match(b, window), "doc long, rid long, start long, words long, text binary"), "matched"))


def _rest(batches, texts: bool):
    """Documents with their removed spans, to the result."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if texts else [])])
    rows: list[tuple] = []
    for batch in batches:
        for part in slices(batch):
            for doc_id, removed, text in zip(part.column("doc_id").to_pylist(), part.column("removed").to_pylist(), _bytes(part.column("text")), strict=True):
                words = (text or b"").split()
                stays = np.ones(len(words), bool)
                for x in removed or ():
                    stays[x["start"] : x["start"] + x["words"]] = False
                kept = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
                rows.append((doc_id, len(words), int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            if texts or len(rows) > 4096:
                yield _batch(rows, schema)
                rows = []
    yield _batch(rows, schema)


def _finish(docs: DataFrame, removed: DataFrame, texts: bool) -> DataFrame:
    """docs: doc, rid, doc_id, text; removed: doc, rid, start, words."""
    of_each = removed.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "words")).alias("removed"))
    joined = docs.join(of_each, ["doc", "rid"], "left").select("doc_id", "removed", "text")
    done = joined.mapInArrow(lambda b: _rest(b, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if texts else ""))
    return done.withColumn("kept", F.col("kept").cast("string")) if texts else done


def _prepared(docs: DataFrame) -> DataFrame:
    """doc (the doc_id to compare by), rid (tells unlike rows of one doc_id apart), start, doc_id, text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).alias("rid"), F.lit(0).cast("long").alias("start"), "doc_id", "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, *, texts: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and, with texts, kept. docs: doc_id, text."""
    cut, first = _round(_prepared(docs), min(anchor, window), window, True)
    _, second = _round(first.where("text is not null").select("doc", "rid", "start", "text"), window, window, False)
    removed = first.unionByName(second).where("text is null").select("doc", "rid", "start", "words")
    rest = _finish(cut.where("kind = 'text'").select("doc", "rid", "doc_id", "text"), removed, texts)
    done = cut.where("kind = 'done'")
    if texts:  # their texts were not carried along
        whole = _prepared(docs).select("doc", "rid", "text").distinct()
        words = F.array_join(F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        done = done.drop("text").join(whole, ["doc", "rid"], "left").withColumn("kept", F.coalesce(words, F.lit("")))
    return rest.unionByName(done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *(["kept"] if texts else [])))


def _known(batches, automata: list[Automaton], window: int):
    rows: list[tuple] = []
    for batch in batches:
        for part in slices(batch):
            for doc, rid, text in zip(part.column("doc").to_pylist(), part.column("rid").to_pylist(), _bytes(part.column("text")), strict=True):
                words = (text or b"").split()
                for one in automata:
                    found = [n >= window for n in one.matches(words)][window - 1 :]
                    rows += [(doc, rid, first, n) for first, n, known in spans(found, window) if known]
            if len(rows) >= 4096:
                yield _batch(rows, pa.schema([f for f in _MATCHED if f.name != "text"]))
                rows = []
    yield _batch(rows, pa.schema([f for f in _MATCHED if f.name != "text"]))


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, *, texts: bool = False) -> DataFrame:
    """The same, of words in windows that any text of the reference holds. reference: text. Its shards' automata are broadcast, ``SHARDS`` a pass."""
    reference = reference.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = reference.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    shards, own = 1 + size // SHARD_WORDS, _prepared(docs)
    removed = []
    for a in range(0, shards, SHARDS):
        automata = []
        for s in range(a, min(a + SHARDS, shards)):
            one = Automaton()
            for r in reference.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == s).toLocalIterator():
                one.add(r["text"].encode("utf-8").split())
            automata.append(one)
        sent = docs.sparkSession.sparkContext.broadcast(automata)
        removed.append(own.select("doc", "rid", "text").distinct().mapInArrow(lambda b, sent=sent: _known(b, sent.value, window), "doc long, rid long, start long, words long"))
    found = removed[0]
    for x in removed[1:]:
        found = found.unionByName(x)
    return _finish(own.select("doc", "rid", "doc_id", "text"), found, texts)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS s FROM words)
), repeated AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) AS owner FROM windows) WHERE owner < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS i FROM repeated
), removed AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda w, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""
