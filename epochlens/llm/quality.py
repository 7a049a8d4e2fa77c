"""Quality selection by importance resampling.

Two generative models of hashed n-grams (tokens and pairs of tokens) are counted over all their occurrences, of target texts and of all raw texts; a
text's importance weight is the ratio of its probabilities under them. Texts are drawn without replacement by Gumbel top-k: those with
the k largest sums of log weight (over a temperature, 1 by default) and Gumbel noise, the noise drawn from a hash of the id, so that a run
can be repeated. The target model's prior is the raw model, so that n-grams of which targets say nothing add nothing.

The ratio says which texts are like targets as a whole: a long text makes up for a few bad words by many good ones. Whether a text is
rejected outright is decided by a second sum over the same kind of counts, its ``penalty``: each n-gram that the text holds (tokens, pairs and stems, once
each) counts with its log ratio at the end of its confidence interval that is nearer to zero, and only where even that is below ``-EFFECT``.
Every n-gram is counted in two buckets there and takes the ratio nearer to zero, so that it takes two collisions to blame it for others.
Rejected are texts below the penalty that best parts the labelled targets from the other labelled rows; of the others k are drawn.

Every label counts, and every count and weight covers all rows. Up to ``SENT_LABELS`` labels are sent to all tasks; where there are more, rows meet
them by shuffles: of the texts only those move that a bitmap of the targets' hashed ids doesn't rule out, and for the penalty's cut no text moves.

Defined results: null, empty and blank texts have no n-gram, and weight and penalty 0; rows with a null id, and repeated rows, are weighed like any other (the same
id has the same noise); without labelled targets nothing is known, weights are 0 and no row is rejected; keys are compared in steps of ``KEY_STEP``, and rows in the
step of the cut are all drawn; an empty table gives no rows; texts of any length are handled whole; further columns are left behind (``keep_drawn`` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import materialised, series_slices, slices, table, texts
from epochlens.llm.ngrams import Tokens, pair_hashes

#: Bits of a bucket, bytes of the stems, kinds of n-grams, buckets (each kind has two tables) and bucket numbers that travel in one row.
BITS, STEMS, KINDS, BLOCK = 18, (4, 6), 4, 1 << 13
BUCKETS = 2 * KINDS << BITS
#: Labels that are sent to all tasks, 9 bytes each; and bits of the bitmap of ids where there are more.
SENT_LABELS, ID_BITS = 200_000, 1 << 26
#: Pieces in which the models' counts come to the driver, some 5 MB each.
PIECES = 8
#: Counts added to both sides, standard errors off the log ratio, and what it must be below then.
PRIOR, ERRORS, EFFECT = 4.0, 3.0, 0.7
#: Cells of the generative models: tokens, then pairs; and how many occurrences of each cell the target model's prior weighs, on average.
GENERATIVE, SMOOTHING = 2 << BITS, 1.0
TOTAL = BUCKETS + GENERATIVE
#: Log weights are divided by this before the noise is added.
TEMPERATURE = 1.0
SEED = 20240601
#: Steps of penalty in the calibration's histogram; steps of keys that count as one, and into how many parts the search for the cut divides.
WEIGHT_STEP, KEY_STEP, KEY_PARTS = 0.05, 2.0**-16, 1024


def _buckets(sources: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both buckets, and the text, of every distinct n-gram of a text; the cell, and the text, of every occurrence of a token or pair."""
    t = Tokens(sources)
    pairs, of = pair_hashes(t)
    kinds = [(t.hash, t.text), (pairs, of), *((t.stems(n), t.text) for n in STEMS)]
    wide = 2 * BITS
    code = np.concatenate([(h >> np.uint64(64 - wide)).astype(np.int64) + (k << wide) + text * (KINDS << wide) for k, (h, text) in enumerate(kinds)])
    code = np.unique(code)
    kind, mask = (code >> wide) % KINDS << BITS, (1 << BITS) - 1
    cells = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS) for k, (h, _) in enumerate(kinds[:2])])
    return kind + (code >> BITS & mask), (KINDS << BITS) + kind + (code & mask), code // (KINDS << wide), cells, np.concatenate([t.text, of])


def count_models(docs: DataFrame) -> np.ndarray:
    """docs (text, target) to 2 x TOTAL: n-grams of all texts, and of the target ones; the buckets, then the cells of the generative models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, TOTAL), np.int64)
        for batch in batches:
            for part in slices(batch):
                one, two, text, cells, of = _buckets(texts(part.column(0)))
                is_target = np.array(part.column(1).to_pylist(), bool)
                for cell, own in ((one, text), (two, text), (cells + BUCKETS, of)):
                    held[0] += np.bincount(cell, minlength=TOTAL)
                    held[1] += np.bincount(cell[is_target[own]], minlength=TOTAL)
        blocks = held.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        for k in some:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k].astype("<i4").tobytes()], pa.binary())], ["block", "n"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in rows:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(n, "<i4").astype("<i8")
        for k, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["block", "n"])

    schema = "block int, n binary"
    parts = docs.mapInArrow(run, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((2 * TOTAL // BLOCK, BLOCK), np.int64)
    for r in parts.coalesce(PIECES).toLocalIterator():  # a job for each piece; as many rows as there are blocks, whatever the number of texts
        out[r["block"]] += np.frombuffer(r["n"], "<i8")
    return out.reshape(2, TOTAL)


def generative_ratios(counts: np.ndarray) -> np.ndarray:
    """Per cell the log of its probability in the target model over that in the raw model; tokens and pairs are a model each."""
    out = np.zeros(GENERATIVE, np.float32)
    for at in range(0, GENERATIVE, 1 << BITS):
        raw, target = (counts[k, BUCKETS + at : BUCKETS + at + (1 << BITS)].astype(float) for k in (0, 1))
        if target.sum():
            p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
            prior = SMOOTHING * len(raw)
            out[at : at + (1 << BITS)] = np.log((target + prior * p_raw) / (target.sum() + prior) / p_raw)
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Per bucket the log of target over raw probability, moved towards zero by its standard errors; each table is a model of its own."""
    out = np.zeros(BUCKETS, np.float32)
    for at in range(0, BUCKETS, 1 << BITS):
        raw, target = counts[0, at : at + (1 << BITS)].astype(float), counts[1, at : at + (1 << BITS)].astype(float)
        if not target.sum():
            continue
        expected = raw * (target.sum() / raw.sum())
        ratio = np.log((target + PRIOR) / (expected + PRIOR))
        error = np.sqrt(1 / (target + PRIOR) + 1 / (expected + PRIOR))
        bound = ratio + ERRORS * error
        out[at : at + (1 << BITS)] = np.where(bound < -EFFECT, bound, 0)
    return out


def weights_of(ratios: np.ndarray, generative: np.ndarray, spark: SparkSession, text: Column) -> Column:
    """log_weight, the sum of all occurrences' log ratios, and penalty, that of the distinct n-grams' bounded ones."""
    shared = spark.sparkContext.broadcast((ratios, generative))  # TOTAL floats

    @F.pandas_udf("log_weight double, penalty double")
    def weigh(text: pd.Series) -> pd.DataFrame:
        ratios, generative = shared.value
        out = [np.zeros((0, 2))]
        for some in series_slices(text):
            one, two, own, cells, of = _buckets([(x or "").encode() for x in some])
            out.append(np.stack([np.bincount(of, generative[cells], len(some)), np.bincount(own, np.maximum(ratios[one], ratios[two]), len(some))], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["log_weight", "penalty"])

    return weigh(text.cast("string"))


def gumbel(id_col: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col.cast("string"), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def least_key(rows: DataFrame, key: str, k: int) -> float:
    """The key from which on the k largest lie, at most KEY_STEP below the k-th one: found by counting in ever finer parts, KEY_PARTS rows each time; no row is sorted or moved."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if k >= ends["n"]:
        return float("-inf")
    lo, hi, need = ends["lo"], ends["hi"], k
    while hi - lo > KEY_STEP:
        width = (hi - lo) / KEY_PARTS
        part = F.least(F.floor((F.col(key) - lo) / width), F.lit(KEY_PARTS - 1)).cast("int")
        counts = {c["part"]: c["count"] for c in rows.where((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(part.alias("part")).count().collect()}
        for p in sorted(counts, reverse=True):
            if need <= counts[p]:
                break
            need -= counts[p]
        lo, hi = lo + p * width, (hi if p == KEY_PARTS - 1 else lo + (p + 1) * width)
    return lo


def best_cut(histogram: list[tuple[float, int, int]]) -> float:
    """histogram: (lower end, targets, others); the weight from which on to keep, that parts them best; the lowest of equals."""
    total_t, total_o = (max(1, sum(h[k] for h in histogram)) for k in (1, 2))
    kept_t, kept_o = 1.0, 1.0
    best, cut = kept_t - kept_o, -np.inf
    for edge, t, o in sorted(histogram):
        if kept_t - kept_o > best + 1e-12:
            best, cut = kept_t - kept_o, edge
        kept_t -= t / total_t
        kept_o -= o / total_o
    return float(cut)


def _known(labels: DataFrame, id_col: str, target: Column | None) -> tuple[DataFrame, bool]:
    """id, target of every labelled id, written down (an id whose rows disagree is no target), and whether they are few enough to be sent to all tasks."""
    target = target if target is not None else (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    known = labels.select(F.col(id_col).alias("id"), F.coalesce(target, F.lit(False)).alias("target")).where("id is not null").groupBy("id").agg(F.min("target").alias("target"))
    known = materialised(known, "labels")
    return known, known.count() <= SENT_LABELS


def _hashed(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("string")), F.lit(ID_BITS))


def may_be_in(ids: DataFrame) -> Column:
    """Whether the column id may be one of these ids: false of none of them, true of few others."""
    bitmaps = ids.select(_hashed(F.col("id")).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    held = np.zeros((ID_BITS // (1 << 15) + 2, 1 << 12), np.uint8)
    for r in bitmaps.coalesce(PIECES).toLocalIterator():  # ID_BITS / 8 bytes in all, however many ids there are
        held[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def holds(bucket: pd.Series, position: pd.Series) -> pd.Series:
        return pd.Series((shared.value[bucket.to_numpy(), position.to_numpy() >> 3] >> (position.to_numpy() & 7).astype(np.uint8) & 1).astype(bool))

    h = _hashed(F.col("id"))
    return holds(F.bitmap_bucket_number(h), F.bitmap_bit_position(h))


def _targets(rows: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """text, target of all rows (id, text)."""
    targets = known.where("target")
    if few:
        found = rows.join(F.broadcast(targets), "id", "left")
    elif rows.schema["id"].dataType != known.schema["id"].dataType or rows.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte", "string"):
        found = rows.join(targets, "id", "left")  # ids that are equal as other types need not be equal as texts
    else:
        asked = rows.withColumn("_may", F.col("id").isNotNull() & may_be_in(targets))
        found = asked.where("_may").drop("_may").join(targets, "id", "left").unionByName(asked.where("not _may").drop("_may").withColumn("target", F.lit(None).cast("boolean")))
    return found.select("text", F.coalesce("target", F.lit(False)).alias("target"))


def _weighed(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, target: Column | None, carry: bool) -> tuple[DataFrame, float]:
    """Rows with id, log_weight and penalty (and all of docs as a struct, row), written down; and the penalty that parts the labels best."""
    known, few = _known(labels, id_col, target)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    counts = count_models(_targets(rows.select("id", "text"), known, few))
    scored = rows.withColumn("w", weights_of(log_ratios(counts), generative_ratios(counts), docs.sparkSession, F.col("text"))).drop("text")
    scored = materialised(scored.select("*", "w.*").drop("w"), "weights")
    if not counts[1].any():
        return scored, float("-inf")
    edge = F.floor(F.greatest(F.least(F.col("penalty"), F.lit(100.0)), F.lit(-100.0)) / WEIGHT_STEP) * WEIGHT_STEP
    labelled = scored.select("id", "penalty").join(F.broadcast(known) if few else known, "id")
    histogram = labelled.groupBy(edge.alias("edge")).agg(F.count_if("target").alias("t"), F.count_if(~F.col("target")).alias("o")).collect()  # 4,001 rows at most
    return scored, best_cut([(float(h["edge"]), h["t"], h["o"]) for h in histogram])


def _drawn(scored: DataFrame, cut: float, share: float | None, temperature: float, seed: int) -> DataFrame:
    """With key, kept (not rejected) and drawn: of the rows kept the given share, by Gumbel top-k; all of them without a share."""
    rows = scored.withColumn("key", F.col("log_weight") / temperature + gumbel(F.col("id"), seed)).withColumn("kept", F.col("penalty") >= cut)
    if share is None:
        return rows.withColumn("drawn", F.col("kept"))
    kept = rows.where("kept")
    return rows.withColumn("drawn", F.col("kept") & (F.col("key") >= least_key(kept, "key", round(share * kept.count()))))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: Column | None = None, share: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """id, log_weight, penalty, key, kept, drawn for each row of docs. labels: id_col and what ``target`` tests, the default being quality = 1 without toxic = 1."""
    return _drawn(*_weighed(docs, labels, id_col, text_col, target, False), share, temperature, seed).select("id", "log_weight", "penalty", "key", "kept", "drawn")


def keep_drawn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: Column | None = None, share: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn (without a share: all that aren't rejected), with docs' columns; they are written down with their weights once and never joined back."""
    return _drawn(*_weighed(docs, labels, id_col, text_col, target, True), share, temperature, seed).where("drawn").select("row.*")


#: Share of the rows kept that the query draws.
DRAWN_SHARE = 0.5


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), share=DRAWN_SHARE)
    return found.select(F.col("id").alias("doc_id"), "log_weight", "penalty", "key", "kept", "drawn")
