"""SimHash near-duplicates by a generalised pigeonhole search.

64-bit fingerprints that differ in at most k bits are found without comparing all pairs. The bits are split into parts, bits that go
together in the same part; part i gets a threshold t_i (-1: left out) with sum(t_i + 1) = k + 1, so that two fingerprints within k bits are
within t_i bits in some part i. Parts and thresholds are chosen by dynamic programming on the candidates that each would give,
estimated from exact counts over all distinct fingerprints: the sum of the squared sizes of a part's groups, and the bits' own frequencies.

A fingerprint enters a part under its own key and, for t_i = 1, under the keys with one of the part's bits left out. Small groups of one key are
verified pair by pair. In a large one, of many near copies, its members are linked through their neighbourhoods instead: two
fingerprints are within two bits exactly if they share a fingerprint that is within one bit of both, and at most 65 distinct
fingerprints are within one bit of any, so that every group made that way is bounded and no pair is lost.

``first_of_each`` drops near-duplicate texts: this search gives its first candidates, the texts' shingles confirm them, and fingerprints of smallest shingle
hashes find, beside it, what is alike but further than k bits apart.

Equal fingerprints count once in all of this; copies come back at the end by a join on the fingerprint.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows and ties fall in one
component, named by its smallest id; an empty table gives no rows; texts of any length are handled whole; further columns are left behind.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.llm.common import doc_texts, folded_words, materialised, slices, table, texts
from epochlens.llm.ngrams import Tokens, mixed, run_hashes
from epochlens.operators.graph import components

BITS = 64
#: Groups of one key up to this size are verified pair by pair.
SMALL_GROUP = 32
#: A fingerprint of over this share of all rows counts as frequent: there are fewer than FREQUENT of them, 16 bytes each.
FREQUENT = 4096


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in map(b" ".join, runs)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Each bit that is set in over half the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id, fp: the fingerprint of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [majority_bits(shingle_hashes(folded_words(t), width, seed)) for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and how many have both of two bits; each task sends one row of 64 x 64 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(got), 1 << 14):
                bits = np.unpackbits(got[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(got)
        if n:
            cells = np.append(both.astype(np.int64).ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1)
    for c in cells:
        flat[c["cell"]] = c["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """Bits in an order that keeps those together that go together: from the last bit on to the most correlated one left."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, -1)
    order, left = [0], set(range(1, BITS))
    while left:
        order.append(max(left, key=lambda b: (linked[order[-1], b], -b)))
        left.remove(order[-1])
    return order


def cut(order: list[int], parts: int) -> list[int]:
    """Masks of so many parts of almost equal size, as signed longs."""
    sizes = [len(order) // parts + (i < len(order) % parts) for i in range(parts)]
    masks, at = [], 0
    for s in sizes:
        mask = sum(1 << b for b in order[at : at + s])
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
        at += s
    return masks


def bits_of(mask: int) -> list[int]:
    return [b for b in range(BITS) if mask >> b & 1]


def group_squares(fps: DataFrame, masks: list[int]) -> dict[int, float]:
    """For each mask the sum of the squared sizes of the groups of one key, over all fingerprints."""
    keyed = fps.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks))).alias("x")).select("x.*")
    counted = keyed.groupBy("mask", "key").count().groupBy("mask").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    return {r["mask"]: r["squares"] for r in counted.collect()}  # a row for each mask


def allocate(k: int, costs: list[dict[int, float]]) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = k + 1 of the least total cost, by dynamic programming; costs: threshold to cost, for each part."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for of in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in of.items():
                if used + t + 1 <= k + 1 and (used + t + 1 not in new or cost + c < new[used + t + 1][0]):
                    new[used + t + 1] = (cost + c, [*chosen, t])
        best = new
    return best.get(k + 1, (float("inf"), []))


#: Cost of a key that is made, shuffled and grouped, in candidates verified.
KEY_COST = 20.0


def plan_parts(fps: DataFrame, k: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts to search; splits into (k + 2) // 2 to k + 1 parts of almost equal size are weighed, as a threshold is 1 at most."""
    n, both = bit_statistics(fps)
    order = correlated_order(n, both)
    p = np.diag(both) / max(n, 1)
    alike = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1.0)  # two fingerprints agree in the bit
    splits = [cut(order, parts) for parts in range(max(1, (k + 2) // 2), k + 2)]
    squares = group_squares(fps, sorted({m for s in splits for m in s}))

    def cost(mask: int) -> dict[int, float]:
        at_zero = squares.get(mask, 0.0) / 2
        odds = sum((1 - alike[b]) / alike[b] for b in bits_of(mask))
        return {-1: 0.0, 0: KEY_COST * n + at_zero, 1: KEY_COST * n * (1 + len(bits_of(mask))) + at_zero * (1 + odds)}

    best = min((allocate(k, [cost(m) for m in s]) + (s,) for s in splits), key=lambda x: x[0])
    return [(m, t) for m, t in zip(best[2], best[1], strict=True) if t >= 0]


def _keys(fps: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """fp, part, hole, key: the keys under which each fingerprint is looked up; hole is the bit left out, -1 for none."""
    wanted = []
    for part, (mask, t) in enumerate(plan):
        for hole in [-1, *(bits_of(mask) if t else [])]:
            kept = mask & (1 << 64) - 1 & ~(1 << hole if hole >= 0 else 0)
            wanted.append((part, hole, kept - (1 << 64) if kept >> 63 else kept))
    return fps.select("fp", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(h).alias("hole"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for p, h, m in wanted))).alias("x")).select("fp", "x.*")


def links(fps: DataFrame, plan: list[tuple[int, int]], k: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all pairs within k bits. k is 2 at most."""
    keyed = _keys(fps, plan)
    by = ["part", "hole", "key"]
    sizes = keyed.groupBy(*by).count().where("count > 1")
    shared = keyed.join(sizes, by)
    # small groups: bounded lists, each pair verified
    small = shared.where(F.col("count") <= SMALL_GROUP).groupBy(*by).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(SMALL_GROUP))).alias("b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k)
    # large groups: members meet at the fingerprints within a bit of them
    radius = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(BITS)))
    crowd = shared.where(F.col("count") > SMALL_GROUP).select("fp").distinct()
    if k == 1:
        meeting = crowd.select("fp", F.explode(radius).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
        met = meeting.join(crowd.select(F.col("fp").alias("at")), "at").where("fp <> at").select(F.col("fp").alias("a"), F.col("at").alias("b"))
    elif k == 2:
        meeting = crowd.select("fp", F.explode(radius).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
        groups = meeting.groupBy("at").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # at most 65 each
        met = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    else:
        raise ValueError("large groups are linked for one or two bits only")
    return near.unionByName(met)


def near_components(prints: DataFrame, *, k: int = 2) -> DataFrame:
    """id, fp to id, fp, component: the smallest id that can be reached over fingerprints within k bits."""
    first = materialised(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "fingerprints")
    fps = first.select("fp")
    plan = plan_parts(fps, k)
    roots = components(links(fps, plan, k))  # of fingerprints
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of_fp = materialised(named.join(least, "root").select("fp", "component", "n"), "components")
    bound = prints.count() // FREQUENT
    frequent = of_fp.where(F.col("n") > bound).select("fp", F.col("component").alias("frequent"))
    rare = of_fp.where(F.col("n") <= bound).select(F.col("fp").alias("key"), "component")
    rows = prints.join(F.broadcast(frequent), "fp", "left")
    # rows of frequent fingerprints have nothing to look up any more: they get keys of their own, and spread
    key = F.when(F.col("frequent").isNull(), F.col("fp").cast("decimal(20,0)")).otherwise(F.xxhash64("id").cast("decimal(20,0)") + F.lit("20000000000000000000").cast("decimal(20,0)"))
    found = rows.withColumn("key", key).join(rare.withColumn("key", F.col("key").cast("decimal(20,0)")), "key", "left")
    return found.select("id", "fp", F.coalesce("frequent", "component").alias("component"))


# --- near-duplicate texts: fingerprints of smallest hashes as candidates, shingles as the proof -----------------------------

SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: Parts of a fingerprint and components of a part. Two texts of similarity s agree in a part with odds s ** PART_SIZE, and in one of all parts, at
#: the least similarity, with odds of 0.9994; a part must agree in all its components, as a threshold of 0 says.
PARTS, PART_SIZE = 14, 4
#: Bits of the components (one each, of BITS components) in which two alike texts may differ: at the least similarity 6.4 do on average, 2.4 the
#: standard deviation, so that one pair in 100,000 has more.
MOST_BITS = 17
#: Leaders of a large group that each of its members is compared with, by different orders of the members.
LEADERS = 4
#: Bytes of a batch for Python workers.
BATCH_BYTES = 4 << 20


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240707).integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def smallest_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x BITS: the smallest value of each text's shingles under each of BITS hash functions; the same greatest value for texts without any."""
    out = np.full((len(bounds) - 1, BITS), np.uint64(2**64 - 1))
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        for j, m in enumerate(_multipliers()):
            out[some, j] = np.minimum.reduceat(mixed(hashes * m), bounds[:-1][some])
    return out


def shingle_prints(rows: DataFrame) -> DataFrame:
    """rows (id, text) to id, t (digest of the text), fp (its SimHash, as ``fingerprints`` gives it), n (distinct shingles), bits (one of each component) and keys (one of each part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sources = texts(part.column(1))
                hashes, bounds, n = distinct_shingles(sources)
                least = smallest_hashes(hashes, bounds)
                bits = np.packbits((least & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0]
                keys = np.zeros((len(sources), PARTS), np.uint64)
                for k in range(PART_SIZE):
                    keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, k * PARTS : (k + 1) * PARTS])
                flat = pa.array(keys.ravel().view(np.int64))
                prints = [majority_bits(shingle_hashes(folded_words(s), 3, 42)) for s in sources]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.md5(s).digest() for s in sources], pa.binary()), pa.array(prints, pa.int64()), pa.array(n), pa.array(bits), pa.ListArray.from_arrays(np.arange(len(sources) + 1, dtype=np.int32) * PARTS, flat)], ["id", "t", "fp", "n", "bits", "keys"]
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t binary, fp long, n long, bits long, keys array<long>")


def distinct_shingles(sources: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, one text after the other; where each text's begin; their numbers."""
    hashes, of = run_hashes(Tokens(sources, fold=True, whole=True), SHINGLE_WORDS)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(hashes) else np.zeros(0, bool)
    hashes, of = hashes[once], of[once]
    bounds = np.searchsorted(of, np.arange(len(sources) + 1))
    return hashes, bounds, np.diff(bounds)


def _plausible(a: str, b: str) -> Column:
    """Sizes that a similarity of LEAST_SIMILARITY allows, and bits that agree well enough."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small >= F.lit(LEAST_SIMILARITY) * large) & (F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= MOST_BITS)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Plausible pairs of structs (a, b) that lie apart, as pairs of t, each once."""
    apart = F.col("a.root") != F.col("b.root") if "root" in pairs.schema["a"].dataType.names else F.col("a.t") != F.col("b.t")
    return pairs.where(apart & _plausible("a", "b")).select(F.least("a.t", "b.t").alias("a"), F.greatest("a.t", "b.t").alias("b")).distinct()


def _pairs_with_first(entered: DataFrame) -> DataFrame:
    """entered (g, x), members of a group g once each: each member with its group's first one, that of which the groups have the most members together. Of the copies of a text it is the one nearest
    to what they have in common (the text itself, if it is there), so that one comparison links most of them; the order is one for all groups."""
    sizes = entered.groupBy("g").agg(F.count("*").alias("members")).where("members > 1")
    met = materialised(entered.join(sizes, "g"), "met")
    central = met.groupBy(F.col("x.t").alias("t")).agg(F.sum("members").alias("central"))
    ranked = met.select("g", "x", F.col("x.t").alias("t")).join(central, "t")
    first = ranked.groupBy("g").agg(F.min_by("x", F.struct(-F.col("central"), F.xxhash64("t"))).alias("a"))
    return _ordered(met.join(first, "g").select("a", F.col("x").alias("b")))


def _pairs_within(entered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entered (g, x with root) to pairs of members that lie apart, and the large groups.

    All such pairs of small groups are given; in large ones each member meets LEADERS members only, and what is left is for the caller.
    """
    sizes = entered.groupBy("g").agg(F.count("*").alias("members"), *(F.min_by("x", F.xxhash64("x.t", F.lit(o))).alias(f"lead{o}") for o in range(LEADERS))).where("members > 1")
    sizes = materialised(sizes, "groups")
    small = entered.join(sizes.where(F.col("members") <= SMALL_GROUP).select("g"), "g").groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = small.select("xs", F.posexplode("xs").alias("i", "a")).select("a", F.explode(F.slice("xs", F.col("i") + 2, F.lit(SMALL_GROUP))).alias("b"))
    large = sizes.where(F.col("members") > SMALL_GROUP)
    led = entered.join(large, "g").select(F.col("x").alias("a"), F.explode(F.array(*(f"lead{o}" for o in range(LEADERS)))).alias("b"))
    return _ordered(pairs.unionByName(led)), large.select("g")


def _of_several_families(entered: DataFrame, roots: DataFrame) -> DataFrame:
    """entered with each member's root, of the groups only whose members have several."""
    named = entered.select("g", F.col("x.t").alias("t"), "x.n", "x.bits").join(roots.withColumnRenamed("node", "t"), "t", "left").select("g", F.struct("t", "n", "bits", F.coalesce("root", "t").alias("root")).alias("x"))
    named = materialised(named, "named")
    several = named.groupBy("g").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo <> hi").select("g")
    return named.join(several, "g")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written down inside goes to Python in batches of BATCH_BYTES: a batch stands in the executor and in its worker, and pairs of sets are wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the sets (t, shingles) have a Jaccard similarity of LEAST_SIMILARITY at least; two empty sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= LEAST_SIMILARITY * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(sets.select(F.col("t").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("shingles").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (id, t, text), wanted (t, id: the row that stands for t) to t, shingles: the distinct 64-bit hashes of all runs of SHINGLE_WORDS words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds, _ = distinct_shingles(texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["t", "shingles"])

    wanted = wanted.select(F.col("t").alias("_t"), F.col("id").alias("_id"))
    found = rows.join(wanted, (rows["t"] == wanted["_t"]) & rows["id"].eqNullSafe(wanted["_id"]), "left_semi").select("t", "text")
    return materialised(found.mapInArrow(run, "t binary, shingles binary"), "shingles").dropDuplicates(["t"])


def _prefix_groups(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """crowd (x, once each), sets (t, shingles) to (g, x): each text under the rarest of its shingles, so many that texts of LEAST_SIMILARITY share one of them at least, whatever else they share.

    Of n shingles n - ceil(LEAST_SIMILARITY n) + 1 are enough if all texts take theirs in one order, here by how many texts of the crowd have them; those that only one text has lead to no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                held = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["t", "g"])

    tokens = materialised(sets.select("t", "shingles").mapInArrow(run, "t binary, g long"), "tokens")
    shared = tokens.join(tokens.groupBy("g").agg(F.count("*").alias("texts")).where("texts > 1"), "g")
    own = W.partitionBy("t")
    placed = shared.withColumn("behind", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("texts", "g")))
    # as many shingles as lie behind one in the order, and itself, must be left to reach the least share
    met = placed.join(crowd.select("x", F.col("x.t").alias("t")), "t").where(F.col("behind") + 1 >= F.ceil(F.lit(LEAST_SIMILARITY) * F.col("x.n") - 1e-6))
    return met.select("g", "x")


def _across_families(entered: DataFrame) -> DataFrame:
    """entered (g, x with root) to pairs of members that lie apart: all of them where SMALL_GROUP members at most lie outside a group's largest family, be that as large as it may; else those with the leaders."""
    families = entered.groupBy("g", F.col("x.root").alias("root")).agg(F.count("*").alias("n"))
    tops = families.groupBy("g").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"))
    tops = materialised(tops.where(F.col("members") > F.col("top.n")), "families")
    few = tops.where(F.col("members") - F.col("top.n") <= SMALL_GROUP).select("g", F.col("top.root").alias("top"))
    held = entered.join(few, "g")
    outside = held.where(F.col("x.root") != F.col("top")).select("g", F.col("x").alias("a"))
    pairs = _ordered(held.select("g", F.col("x").alias("b")).join(outside, "g").select("a", "b"))
    led, _ = _pairs_within(entered.join(tops.where(F.col("members") - F.col("top.n") > SMALL_GROUP).select("g"), "g", "left_semi"))
    return pairs.unionByName(led).distinct()


def _simhash_pairs(distinct: DataFrame, k: int = 2) -> DataFrame:
    """Plausible pairs of texts whose SimHash fingerprints lie within k bits, by the generalised pigeonhole search: of the texts of one fingerprint one stands for all, and is paired with each of the others."""
    texts_of = materialised(distinct.select("fp", F.struct("t", "n", "bits").alias("x")), "simhash")
    heads = materialised(texts_of.groupBy("fp").agg(F.min("x").alias("head")), "heads")
    fps = heads.select("fp")
    found = links(fps, plan_parts(fps, k), k)
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"_{side}"))
    across = found.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return _ordered(texts_of.join(heads, "fp").select(F.col("head").alias("a"), F.col("x").alias("b")).unionByName(across))


def near_duplicate_roots(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """rows (id, t, text), distinct (t, id, fp, n, bits, keys) to (node, root) of t, for every text that is near another.

    First the texts whose SimHash fingerprints are near, found by the search above; those that their shingles confirm are linked. What is as much alike and yet further apart in these bits
    meets in the groups of its parts' keys. There each member of a group is compared with the group's first one, which links the copies of
    one text however many there are. Where this leaves members of a group apart, they are held against each other: all of them in a group of up to
    SMALL_GROUP, with LEADERS of them in a larger one. What is still apart in larger groups meets by the rarest of its shingles, which no two texts of the least similarity have all apart;
    each of them outside the largest family that shares one of these is held against all that do. Only where more than SMALL_GROUP are outside it do members again meet LEADERS of them alone.
    """
    entered = distinct.select(F.posexplode("keys").alias("part", "key"), F.struct("t", "n", "bits").alias("x")).select(F.xxhash64("part", "key").alias("g"), "x")
    entered = materialised(entered, "entered")
    tried = links = None

    def verified(pairs: DataFrame) -> bool:
        """Adds the links among pairs not tried before; False if there was none to try."""
        nonlocal tried, links
        new = materialised(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not new.limit(1).count():
            return False
        wanted = new.select(F.col("a").alias("t")).unionByName(new.select(F.col("b").alias("t"))).distinct()
        found = materialised(similar_pairs(new, shingle_sets(rows, distinct.join(wanted, "t", "left_semi").select("t", "id"))), "links")
        tried, links = (new, found) if tried is None else (tried.unionByName(new), links.unionByName(found))
        return True

    any_near = verified(_simhash_pairs(distinct))
    if not (verified(_pairs_with_first(entered)) or any_near):
        return distinct.select(F.col("t").alias("node"), F.col("t").alias("root")).where("false")
    roots = components(links)
    pairs, large = _pairs_within(_of_several_families(entered, roots))
    if verified(pairs):
        roots = components(links)
    crowd = entered.join(large, "g", "left_semi")
    if not crowd.limit(1).count():
        return roots
    apart = materialised(_of_several_families(crowd, roots).select("x").distinct(), "crowd")
    if not apart.limit(1).count():
        return roots
    sets = shingle_sets(rows, distinct.join(apart.select(F.col("x.t").alias("t")), "t", "left_semi").select("t", "id"))
    return components(links) if verified(_across_families(materialised(_prefix_groups(apart, sets), "rare"))) else roots


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less the near-duplicates: of each group the row with the smallest id stays (one of equal rows). docs' columns stay as they are.

    Near-duplicates are texts of which the sets of five-word shingles have a similarity of 0.8 at least, and what is linked through them. The
    SimHash search finds those of them whose fingerprints are near. Texts at 0.8 differ in ten of its bits on average, so that a second fingerprint, whose components are smallest hashes,
    finds the others; the shingles themselves decide of both.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("t"), text.alias("text"))
    with small_batches(docs.sparkSession):
        prints = materialised(shingle_prints(rows.select("id", "text")), "prints")
        distinct = materialised(prints.groupBy("t").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "texts")
        roots = near_duplicate_roots(rows, distinct)
    named = distinct.select("t", "id").join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("id"), F.col("t"))).alias("stays"))
    stays = materialised(least.select("stays.*"), "stays")
    mark = "_t"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.unhex(F.md5(text)))
    stays = stays.select(F.col("id").alias("_stay_id"), F.col("t").alias("_stay_t"))
    kept = marked.join(stays, marked[mark].eqNullSafe(stays["_stay_t"]) & marked[id_col].eqNullSafe(stays["_stay_id"]), "left_semi")
    again = prints.groupBy("id", "t").count().where("count > 1").select("id", F.col("t").alias("again")).limit(1)
    if again.count():  # equal rows: one of them stays
        kept = kept.dropDuplicates([id_col, mark])
    return kept.drop(mark)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialised(fingerprints(table(spark, sf_dir, "documents")), "prints")
    found = near_components(prints, k=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def brute_force_components(ids: list, prints: list[int], k: int = 2) -> dict:
    """For tests: every pair compared."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, prints, strict=True), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= k:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
