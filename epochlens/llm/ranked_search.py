"""Ranked lexical search: variable-block-max WAND, shard by shard.

Documents are cut into shards, as they lie in the tasks; a shard holds the postings of the queries' terms with each posting's part of the score. A term's list
is cut into blocks of unequal length by dynamic programming: the bound error (what the block's greatest part promises beyond what its postings hold) plus
a price for each block is least. A query takes its lists with the greatest promise first. A document that is in none of the lists before can have what a list's block promises and what the blocks of later
lists promise over the same documents, no more: blocks whose sum doesn't reach the score that the query's last place has so far are skipped unread, and so are all lists from the pivot on, where what is left doesn't reach it
at all. It is the pivot rule, taken a list at a time instead of a document at a time, so that numpy goes through whole blocks. The threshold goes on from shard to shard of a task. Each task gives a query at most k rows, from which Spark takes the k best. The result is exact.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of text, the only thing that is broadcast or goes through the driver, with a number for each of their terms.
Counts of documents, of terms and of each term's documents are over all documents.

Defined results: a null text has no terms; rows with equal doc_id are ranked each; a null doc_id comes last among equal scores; queries that are wholly repeated count once, and
queries of one item_id with unlike texts are ranked each; a query without terms, or an empty table, gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.llm.common import slices, table

#: Bytes of the texts of queries that are searched for at once; postings of a shard; longest block; a block's price in mean parts of its list.
BLOCK_BYTES, SHARD_POSTINGS, LONGEST, PRICE = 1 << 20, 1 << 20, 64, 4
#: Following lists whose blocks are asked for what they promise over a block; of those behind them the list's own promise counts.
NEAR = 8
#: Postings that a query's first look into a list takes; each further one takes twice as many.
FIRST_LOOK = 64
#: Counts a null doc_id as the greatest.
NO_ID = np.iinfo(np.int64).max
#: Bytes that are no part of a term give way to a space, A-Z to a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all further characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


def cut_blocks(parts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of every list at once. parts: the lists one after the other; starts: where each begins, and the end. Gives the blocks' first postings (and the end) and each list's first block (and the end).

    least[i] = min over lengths n of least[i - n] + n * max(parts[i-n:i]) + price; the sum of the parts is the same for all cuts. All lists take step i together.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[:-1][order], lengths[order]
    total = np.add.reduceat(parts, starts[:-1]) if len(lengths) else np.zeros(0, np.int64)
    price = np.maximum(1, PRICE * total[order] // np.maximum(1, length))[:, None]
    size = np.arange(1, LONGEST + 1)
    far = np.int64(1) << 61
    highest = np.zeros((len(order), LONGEST), np.int64)
    before = np.full((len(order), LONGEST), far)
    before[:, 0] = 0
    back = np.zeros(len(parts), np.int64)
    live = len(order)
    for i in range(int(length.max(initial=0))):
        while length[live - 1] <= i:
            live -= 1
        here = parts[begin[:live] + i][:, None]
        top = highest[:live]
        top[:, 1:] = top[:, :-1].copy()
        top[:, 0] = 0
        np.maximum(top, here, out=top)
        cost = before[:live] + top * size + price[:live]
        best = cost.argmin(axis=1)
        back[begin[:live] + i] = best + 1
        least = cost[np.arange(live), best]
        before[:live, 1:] = before[:live, :-1].copy()
        before[:live, 0] = least
    firsts: list[int] = []
    first_block = [0]
    steps = back.tolist()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = []
        while b > a:
            b -= steps[b - 1]
            own.append(b)
        firsts += own[::-1]
        first_block.append(len(firsts))
    return np.array([*firsts, len(parts)], np.int64), np.array(first_block, np.int64)


class Shard:
    """Postings of some documents, in order of doc_id, with block maxima."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, found: np.ndarray, weights: np.ndarray, n: int, total: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, sizes = ids[order], sizes[order]
        keys, tf = np.unique(found * len(ids) + place[docs], return_counts=True)
        term, self.at = np.divmod(keys, max(1, len(ids)))
        m = 75 + (25 * sizes[self.at] * n) // total
        self.parts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term)).astype(np.int64)
        self.blocks, self.first_block = cut_blocks(self.parts, self.starts)
        if len(self.parts):
            self.maxima = np.maximum.reduceat(self.parts, self.blocks[:-1])
        self.looked = 0

    def best(self, query: list[tuple[int, int]], k: int, so_far: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of this shard's documents and those so far. query: (term, times)."""
        lists = []
        for term, times in query:
            i = int(np.searchsorted(self.terms, term))
            if i < len(self.terms) and self.terms[i] == term:
                lists.append((i, times))
        if not lists:
            return so_far
        firsts, lasts, promised = [], [], []
        for i, times in lists:
            a, b = self.first_block[i], self.first_block[i + 1]
            firsts.append(self.at[self.blocks[a:b]])
            lasts.append(self.at[self.blocks[a + 1 : b + 1] - 1])
            promised.append(self.maxima[a:b] * times)
        order = sorted(range(len(lists)), key=lambda x: -int(promised[x].max()))
        lists, firsts, lasts, promised = ([x[o] for o in order] for x in (lists, firsts, lasts, promised))
        left = np.append(np.cumsum([int(x.max()) for x in promised][::-1])[::-1], 0)  # what a list and all behind it promise
        scores, ids = so_far
        threshold = lambda: int(scores[-1]) if len(scores) == k else 1
        seen = np.zeros(len(self.ids), bool)
        for i in range(len(lists)):
            if left[i] < threshold():
                break  # the pivot: documents that are in none of the lists before have too little
            bound = promised[i] + left[i + 1]
            some = np.flatnonzero(bound >= threshold())
            behind = min(len(lists), i + 1 + NEAR)
            bound = promised[i][some] + left[behind]
            for j in range(i + 1, behind):
                bound += self._most(firsts[j], lasts[j], promised[j], firsts[i][some], lasts[i][some])
            order = np.argsort(-bound, kind="stable")
            some, bound = some[order], bound[order]
            done, look = 0, FIRST_LOOK
            begin = self.first_block[lists[i][0]]
            while done < len(some):
                most = int(np.searchsorted(-bound, -threshold(), "right"))  # equal ones may hold a smaller id
                if done >= most:
                    break
                blocks = begin + some[done:most]
                sizes = self.blocks[blocks + 1] - self.blocks[blocks]
                n = 1 + int(np.searchsorted(np.cumsum(sizes), look))
                blocks, sizes = blocks[:n], sizes[:n]
                done, look = done + len(blocks), look * 2
                postings = np.repeat(self.blocks[blocks] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
                postings = np.sort(postings[~seen[self.at[postings]]])
                docs, got = self.at[postings], self.parts[postings] * lists[i][1]
                seen[docs] = True
                self.looked += len(docs)
                for j in range(i + 1, len(lists)):
                    good = got + left[j] >= threshold()
                    docs, got = docs[good], got[good]
                    if not len(docs):
                        break
                    a, b = self.starts[lists[j][0]], self.starts[lists[j][0] + 1]
                    at = np.searchsorted(self.at[a:b], docs)
                    at[at == b - a] = 0
                    hit = self.at[a:b][at] == docs
                    got[hit] += lists[j][1] * self.parts[a:b][at[hit]]
                good = got >= threshold()
                scores, ids = np.append(scores, got[good]), np.append(ids, self.ids[docs[good]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
        return scores, ids

    @staticmethod
    def _most(firsts: np.ndarray, lasts: np.ndarray, promised: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest promise of the blocks [firsts, lasts] that meet each of the stretches [low, high]; 0 where none does."""
        a, b = np.searchsorted(lasts, low), np.searchsorted(firsts, high, "right")
        out = np.maximum.reduceat(np.append(promised, 0), np.column_stack([a, np.maximum(a + 1, b)]).ravel().clip(max=len(promised)))[::2] if len(low) else np.zeros(0, np.int64)
        return np.where(b > a, out, 0)


def _shards(batches, known: dict[bytes, int], weights: np.ndarray, n: int, total: int) -> Iterator[Shard]:
    ids: list[int] = []
    sizes: list[int] = []
    docs: list[np.ndarray] = []
    found: list[list[int]] = []
    held = 0

    def made() -> Shard:
        return Shard(np.array(ids, np.int64), np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.int64), *docs]), np.array([x for xs in found for x in xs], np.int64), weights, n, total)

    look = known.get
    for batch in batches:
        for part in slices(batch):
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    words = terms(text.encode("utf-8"))
                    own = [x for w in words if (x := look(w)) is not None]
                    if own:
                        docs.append(np.full(len(own), len(ids)))
                        found.append(own)
                        ids.append(NO_ID if i is None else i)
                        sizes.append(len(words))
                        held += len(own)
            if held >= SHARD_POSTINGS:
                yield made()
                ids, sizes, docs, found, held = [], [], [], [], 0
    if ids:
        yield made()


def _counts(batches, known: dict[bytes, int]):
    """Of a task's documents: term -1 their number, -2 their terms, else how many documents hold the term."""
    n = total = 0
    df: Counter[int] = Counter()
    look = known.get
    for batch in batches:
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                words = terms(text.encode("utf-8")) if text else []
                if words:
                    n, total = n + 1, total + len(words)
                    df.update({x for w in words if (x := look(w)) is not None})
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *df], pa.int64()), pa.array([n, total, *df.values()], pa.int64())], names=["term", "n"])


def _found(batches, known, queries: list[list[tuple[int, int]]], weights: np.ndarray, n: int, total: int, k: int):
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for shard in _shards(batches, known, weights, n, total):
        for q, query in enumerate(queries):
            best[q] = shard.best(query, k, best[q])
    for a in range(0, len(best), 512):
        some = best[a : a + 512]
        ids = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in some)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(a, a + len(some)), [len(x[0]) for x in some]), pa.int64()),
            pa.array(ids, pa.int64(), mask=ids == NO_ID),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in some)]), pa.int64()),
        ], names=["query", "doc_id", "score"])


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Ranked documents of one block of queries. rows: (item_id, text)."""
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    queries = [list(Counter(known.setdefault(w, len(known)) for w in terms((r["text"] or "").encode("utf-8"))).items()) for r in rows]
    sent = spark.sparkContext.broadcast((known, queries))
    counted = docs.select("text").mapInArrow(lambda batches: _counts(batches, sent.value[0]), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # a number for each term of the block
    n, total = df.get(-1, 0), max(1, df.get(-2, 0))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))], np.int64)
    found = docs.mapInArrow(lambda batches: _found(batches, *sent.value, weights, n, total, k), "query long, doc_id long, score long")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    # the best of each of 64 parts, then of all: however many tasks give rows, none meets them all at once
    some = found.withColumn("place", F.row_number().over(W.partitionBy("query", F.pmod(F.hash("doc_id"), F.lit(64))).orderBy(*order))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. docs: doc_id, text; items: item_id, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).sort("item_id", "text").collect()
        if rows or (out is None and b == blocks - 1):
            one = _block(docs, rows, k)
            out = one if out is None else out.unionByName(one)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), sizes AS (SELECT doc_id, len(ws) AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY 1, 2
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part
  FROM postings JOIN sizes USING (doc_id) JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
