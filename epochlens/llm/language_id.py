"""Language identification of mixed-language text.

Each word's letters name scripts, and only languages that were learned with one of these stay candidates for it. A word's score under a
language is the sum of the log probabilities of its byte trigrams; a Viterbi pass over the words, in which a change of language costs a penalty,
labels spans. A text's language is the one whose spans hold the most letter bytes, and its score is their share.

What is learned: trigram counts in a fixed number of buckets for each language, over all training rows, summed up within tasks and then
across them; the model's size depends on the number of languages only, which is checked against ``MAX_LANGUAGES``.

Defined results: null texts and those without a letter are ``und`` with score 0 and no spans; rows without a language, or with a blank one, are not
learned from; where nothing was learned every text is ``und``; ties go to the language first in order; repeated rows give equal rows; an empty table gives no rows; a null id is in no
fold, so that such a row isn't learned from and its ``held_out`` is null; texts of any length are handled whole, each in memory of some 7 bytes a word and language;
further columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import crc_fold, slices, table, texts

BUCKETS = 1 << 14
MAX_LANGUAGES = 256
#: Nats that a change of language between two words costs.
SWITCH_PENALTY = 12.0
#: A script counts as a language's own from this share of its letters on.
SCRIPT_SHARE = 0.001
#: Texts that take their steps together, and scores (words or bytes by languages) that are held at once; a longer text is taken alone.
VITERBI_ROWS, CELLS = 2048, 1 << 25
UNDETERMINED = "und"

# fixed values: first and last code point of each script's main ranges
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS))


def _script_table() -> np.ndarray:
    """Bit of the script that a character's first two bytes tell; 0 for other characters and for bytes within one."""
    found = np.zeros(1 << 16, np.int32)
    for name, first, last in SCRIPTS:
        bit = 1 << SCRIPT_NAMES.index(name)
        for code in range(first, last + 1):
            b = chr(code).encode("utf-8", "surrogatepass")
            if len(b) == 1:
                found[b[0] << 8 : (b[0] + 1) << 8] = bit
            else:
                found[b[0] << 8 | b[1]] = bit
    return found


_SCRIPT_OF = _script_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Words:
    """Words of several texts in one buffer: byte trigram buckets, script bits, and where words and texts start."""

    def __init__(self, sources: list[bytes]):
        flat = np.frombuffer(b"\n" + b"".join(s.lower() + b"\n" for s in sources) + b"\n", np.uint8)
        space = _SPACE[flat]
        wide = np.where(space, 0x20, flat).astype(np.int64)
        mixed = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA77 + wide[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
        self.bucket = ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 12) & (BUCKETS - 1)
        script = _SCRIPT_OF[(flat[1:-1].astype(np.int64) << 8) | flat[2:]]
        self.letter = script != 0
        inside = ~space[1:-1]
        self.starts = np.flatnonzero(inside & space[:-2])
        self.ends = np.flatnonzero(inside & space[2:]) + 1
        bounds = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sources])])
        self.text_starts = bounds[:-1]
        #: Index of the first word of each text, and the number of all words at the end.
        self.first = np.searchsorted(self.starts, bounds)
        n = len(self.starts)
        self.scripts = np.bitwise_or.reduceat(np.where(inside, script, 0), self.starts) if n else np.zeros(0, np.int32)
        held = np.concatenate([[0], np.cumsum(self.letter)])
        self.letters = held[self.ends] - held[self.starts]


def has_letter(source: bytes) -> bool:
    return bool(_ASCII_LETTER.search(source)) or (not source.isascii() and any(map(str.isalpha, source.decode())))


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict:
    """langs, log (BUCKETS x languages) and scripts (bits of each language's own scripts), from all rows."""
    cells = len(SCRIPT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                sources = texts(part.column(1))
                for lang in dict.fromkeys(langs):
                    w = Words([s for s, x in zip(sources, langs, strict=True) if x == lang])
                    held = counts.setdefault(lang, np.zeros(BUCKETS + cells, np.int64))
                    near = w.letter  # only trigrams around a letter
                    held[:BUCKETS] += np.bincount(w.bucket[near], minlength=BUCKETS)
                    for k in range(cells):
                        held[BUCKETS + k] += int(((w.scripts >> k) & 1).sum())
        for lang, held in counts.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(held[some])], ["lang", "cell", "n"])

    known = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and trim(lang) <> '' and text is not null")
    per_task = known.mapInArrow(run, "lang string, cell int, n long")
    summed = per_task.groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    rows = sorted(summed.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts = np.zeros((len(rows), BUCKETS + cells))
    for k, r in enumerate(rows):
        counts[k, [c["cell"] for c in r["cells"]]] = [c["n"] for c in r["cells"]]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    own = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": [r["lang"] for r in rows], "log": np.ascontiguousarray(log.T, np.float32), "scripts": (own * (1 << np.arange(cells))).sum(axis=1).astype(np.int32)}


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Words x languages; 0 for words without a letter, and out of reach for languages that share no script with the word while another does."""
    n, k = len(w.starts), len(model["langs"])
    if not n:
        return np.zeros((0, k), np.float32)
    scores, width = np.zeros((n, k), np.float32), max(1, CELLS // k)
    ends = np.append(w.starts[1:], len(w.bucket))  # white space after a word adds nothing
    at = 0
    while at < n:
        until = max(at + 1, int(np.searchsorted(ends, w.starts[at] + width, "right")))
        some = slice(w.starts[at], ends[until - 1])
        per_byte = model["log"][w.bucket[some]]
        per_byte[~w.letter[some]] = 0
        scores[at:until] = np.add.reduceat(per_byte, w.starts[at:until] - w.starts[at], axis=0)
        at = until
    shares = (w.scripts[:, None] & model["scripts"][None, :]) != 0
    shares[~shares.any(axis=1)] = True
    return np.where(shares, scores, scores - 1e4)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; first: where each text's words start. All texts take a step at a time, the longest ones last."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, counts = first[:-1][order], counts[order]
    k = scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    best = np.zeros((int((counts > 0).sum()), k))
    live = len(best)
    if not live:
        return np.zeros(len(scores), np.int16)
    best += scores[starts[:live]]
    own = np.arange(k, dtype=np.int16)
    actives = np.searchsorted(-counts, -np.arange(1, counts[0]), side="left")  # texts with over t words
    for t, n in enumerate(actives, 1):
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top][:, None] - penalty
        stay = now >= jump
        at = starts[:n] + t
        came[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, jump) + scores[at]
    last = best.argmax(axis=1).astype(np.int16)
    labels = np.zeros(len(scores), np.int16)
    labels[starts[:live] + counts[:live] - 1] = last
    for t in range(len(actives), 0, -1):
        n = actives[t - 1]
        at = starts[:n] + t
        labels[at - 1] = came[at, labels[at]]
    return labels


def predict_spans(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """id_col, lang_pred, score, spans: array of (start, end, lang) in bytes of the text's UTF-8, runs of words of one language."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGUAGES floats at most

    def label(sources: list[bytes | None]) -> list[tuple]:
        model, rows = shared.value, []
        seen = [s or b"" for s in sources]
        some = [Words(seen[at : at + 128]) for at in range(0, len(seen), 128)]
        scores = np.concatenate([word_scores(w, model) for w in some])
        offsets = np.cumsum([0, *(len(w.starts) for w in some)])
        first = np.concatenate([*(w.first[:-1] + o for w, o in zip(some, offsets, strict=False)), offsets[-1:]])
        labels = viterbi(scores, first, penalty)
        for k, s in enumerate(seen):
            w, a, b = some[k // 128], first[k], first[k + 1]
            base = offsets[k // 128]
            if sources[k] is None or a == b or not has_letter(s):
                rows.append((UNDETERMINED, 0.0, []))
                continue
            own, letters, at = labels[a:b], w.letters[a - base : b - base], w.text_starts[k % 128]
            held = np.bincount(own, letters, len(model["langs"])) if letters.sum() else np.bincount(own, minlength=len(model["langs"])).astype(float)
            top = int(held.argmax())
            cuts = np.flatnonzero(np.diff(own)) + 1
            lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [b - a]]) - 1
            begins, ends = w.starts[a - base : b - base][lo] - at, w.ends[a - base : b - base][hi] - at
            rows.append((model["langs"][top], float(held[top] / held.sum()), [{"start": int(x), "end": int(y), "lang": model["langs"][own[z]]} for x, y, z in zip(begins, ends, lo, strict=True)]))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for part in slices(batch, VITERBI_ROWS, CELLS // max(1, len(shared.value["langs"]))):
                sources = [None if x is None else x.encode() for x in part.column(1).to_pylist()]
                rows = label(sources) if shared.value["langs"] else [(UNDETERMINED, 0.0, [])] * len(sources)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), span)))], ["id", "lang_pred", "score", "spans"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {id_type}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>").withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_fold("doc_id", 5) != 0))
    found = predict_spans(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
