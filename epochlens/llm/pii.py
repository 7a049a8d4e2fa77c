"""Personal data by rules and a semi-Markov conditional random field.

Rules give the base spans. The field adds spans that rules of fixed shape miss (a card number glued to another number, a phone number
without its plus sign, an address with a space before its sign @): it scores whole candidate segments of at most ``MAX_TOKENS`` tokens by features of
the segment as a whole, and one dynamic programme over the tokens chooses boundaries and types jointly. Its weights are fitted by
gradient ascent on the exact conditional likelihood of generated examples (``training_regions``, a fixed seed), so that
they depend on no corpus. An added span needs a posterior of ``LEAST_POSTERIOR`` and touches no base span.

Defined results: null, empty and blank texts have no spans and the digest of the empty string; overlapping spans of different kinds all stay
where rules give them; ties go to the kind listed first; texts of any length are handled whole, in time that grows with their length;
repeated rows give equal rows; further columns are left behind (``redact`` keeps them all).
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import doc_texts, slices, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
LEAST_POSTERIOR = 0.95

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts where the local part before a sign @ starts; if its domain fails, so do all later starts before that sign."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers are taken four by four."""
    for m in _NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start and then kind as listed."""
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, b, "ip") for a, b in _ips(text)]
        found += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- the field ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]")
#: A longer region is taken in windows: so many tokens each whose segments are its own, and MARGIN tokens of the region around them.
REGION_TOKENS, MARGIN = 4096, 2 * MAX_TOKENS


def regions(text: str) -> Iterator[tuple[int, str]]:
    """(start, region): words of a line that hold a digit or the sign @ and follow each other, and the word before them where the first has the sign @."""
    if "@" in text or _DIGIT.search(text):
        for chunk in re.finditer(r"\S+(?:[^\S\n]\S+)*", text):  # lines
            line = chunk[0]
            words, run, start = line.split(" "), [], 0
            at, before = 0, ""
            for w in [*words, ""]:
                if w and (_DIGIT.search(w) or "@" in w):
                    if not run:
                        run = [before] if before and "@" in w else []
                        start = at - sum(len(x) + 1 for x in run)
                    run.append(w)
                elif run:
                    yield chunk.start() + start, " ".join(run)
                    run = []
                at, before = at + len(w) + 1, w


class Region:
    """Tokens of a region, and prefix counts from which whole-segment features come in constant time."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
        self.tokens = [text[a:b] for a, b in zip(self.at, self.at[1:], strict=False)]
        self.n = len(self.tokens)

    def candidates(self) -> list[tuple[int, int, str]]:
        """Segments (first token, end, kind) of a shape that the kind can have."""
        found, t = [], self.tokens
        numeric = [x.isdigit() and x.isascii() for x in t]
        alpha = [x.isalpha() and x.isascii() for x in t]
        for i in range(self.n):
            if numeric[i] and i + 7 <= self.n and all(numeric[i + k] == (k % 2 == 0) for k in range(7)) and t[i + 1] == t[i + 3] == t[i + 5] == ".":
                found.append((i, i + 7, "ip"))
            if numeric[i]:
                digits = 0
                for j in range(i, min(self.n, i + MAX_TOKENS)):
                    if numeric[j]:
                        digits += len(t[j])
                        if digits > 19:
                            break
                        if digits >= 13:
                            found.append((i, j + 1, "card"))
                    elif t[j] not in " -" or not numeric[j - 1]:
                        break
            if numeric[i] or t[i] in "+(":
                digits = 0
                for j in range(i, min(self.n, i + MAX_TOKENS)):
                    if numeric[j]:
                        digits += len(t[j])
                        if digits > 15:
                            break
                        if digits >= 9:
                            found.append((i, j + 1, "phone"))
                    elif t[j] not in " ().-" and not (j == i and t[j] == "+"):
                        break
            if t[i] == "@":
                last = low = i - 1 if i and t[i - 1] == " " else i
                while low > 0 and i - low < MAX_TOKENS // 2 and (numeric[low - 1] or alpha[low - 1] or t[low - 1] in "._%+-"):
                    low -= 1
                high = i + 1
                while high < self.n and high - i < MAX_TOKENS // 2 and (numeric[high] or alpha[high] or t[high] in ".-"):
                    high += 1
                while high > i + 1 and t[high - 1] in ".-":
                    high -= 1
                if high > i + 1 and low < last:
                    found.append((low, high, "email"))
        return found

    def features(self, i: int, j: int, kind: str) -> list[str]:
        """Of the whole segment."""
        a, b = self.at[i], self.at[j]
        s, t = self.text[a:b], self.tokens[i:j]
        digits = _NOT_DIGIT.sub("", s)
        before, after = self.text[a - 1 : a], self.text[b : b + 1]
        gaps = {x for x in t if not x.isalnum()}
        groups = [len(x) for x in t if x.isdigit()]
        out = [f"n={min(len(digits), 20)}" if kind != "email" else "n=0", f"groups={min(len(groups), 6)}", f"gaps={''.join(sorted(gaps))[:4]}" if kind != "email" else "gaps"]
        out += [f"before={'-' if not before else 'a' if before.isalpha() else '0' if before.isdigit() else before}", f"after={'-' if not after else 'a' if after.isalpha() else '0' if after.isdigit() else after}"]
        if kind == "card":
            out += [f"luhn={luhn(digits)}", f"first={digits[:1]}", f"even={len(set(groups)) == 1}", f"luhn={luhn(digits)}&n={len(digits)}&fours={groups[:3] == [4, 4, 4]}"]
        elif kind == "phone":
            out += [f"plus={s[0] == '+'}", f"paren={'(' in s}", f"single={len(groups) == 1}", f"plus={s[0] == '+'}&single={len(groups) == 1}", f"balanced={s.count('(') == s.count(')')}", f"whole={max(groups) <= 5}", f"dots={'.' in s}"]
        elif kind == "ip":
            out += [f"range={all(int(x[:4]) <= 255 for x in t[::2])}", f"zeros={any(len(x) > 1 and x[0] == '0' for x in t[::2])}"]
        else:
            name, _, host = s.partition("@")
            out += [f"dot={'.' in host}", f"last={t[-1].isalpha() and 2 <= len(t[-1]) <= 8}", f"spaced={' ' in s}", f"name={bool(name.strip('._%+- '))}"]
        return [f"{kind}:{x}" for x in out] + [f"{kind}:bias"]


def _scores(region: Region, weights: dict[str, float]) -> list[tuple[int, int, str, list[str], float]]:
    return [(i, j, k, f, sum(weights.get(x, 0.0) for x in f)) for i, j, k in region.candidates() for f in [region.features(i, j, k)]]


def _posteriors(n: int, segments: list) -> np.ndarray:
    """Probability of each segment under the field; tokens outside have score 0."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    outof: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, *_) in enumerate(segments):
        into[j].append(s)
        outof[i].append(s)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ahead[j] = functools.reduce(np.logaddexp, (ahead[segments[s][0]] + segments[s][4] for s in into[j]), ahead[j - 1])
    for i in range(n - 1, -1, -1):
        behind[i] = functools.reduce(np.logaddexp, (behind[segments[s][1]] + segments[s][4] for s in outof[i]), behind[i + 1])
    return np.exp([ahead[s[0]] + s[4] + behind[s[1]] - ahead[n] for s in segments])


def best_segments(n: int, segments: list) -> list[int]:
    """The segmentation of the highest score."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for s, seg in enumerate(segments):
        into[seg[1]].append(s)
    best, came = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in into[j]:
            if (value := best[segments[s][0]] + segments[s][4]) > best[j]:
                best[j], came[j] = value, s
    chosen, j = [], n
    while j > 0:
        chosen, j = ([*chosen, came[j]], segments[came[j]][0]) if came[j] >= 0 else (chosen, j - 1)
    return chosen


def training_regions(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated regions with their spans: entities in many layouts among order numbers, versions, dates, hashes and amounts."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([13, 14, 14, 14, 14, 14, 17]))
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = r.choice(["", "", " ", "-"])
        return gap.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        gap = r.choice([" ", "-", "."])
        kind = r.random()
        if kind < 0.6:
            return "+" + gap.join([digits(r.choice([1, 2])), digits(3), digits(3), digits(4)]) if r.random() < 0.6 else "+" + digits(r.choice([11, 12]))
        return f"({digits(3)}) {digits(3)}-{digits(4)}" if kind < 0.85 else "-".join([digits(3), digits(3), digits(4)])

    def email() -> str:
        return letters(r.randint(2, 9)) + r.choice(["", ".", "_"]) + r.choice(["", letters(4), digits(2)]).strip(".") + r.choice(["@", "@", "@", " @"]) + letters(r.randint(3, 8)) + r.choice(["", digits(1)]) + "." + r.choice(["com", "org", "net", "example.com", "de", "fr"])

    def other() -> str:
        return r.choice([lambda: digits(r.randint(1, 12)), lambda: digits(r.randint(13, 20)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: "v" + digits(1) + "." + digits(1), lambda: digits(3) + "," + digits(3), lambda: "@" + letters(5), lambda: "###" + digits(9) + "###", lambda: f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}", lambda: " ".join(digits(r.randint(1, 5)) for _ in range(r.randint(2, 6))), lambda: letters(4) + "@" + letters(4), lambda: "-".join(digits(4) for _ in range(4)), lambda: "+" + digits(r.randint(1, 6))])()

    made = {"card": card, "phone": phone, "email": email, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += r.choice(["", "###", "(", "'", ":"]) if not text else r.choice([" ", " ", ", ", "; ", "/"])
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                s = made[kind]()
                spans.append((len(text), len(text) + len(s), kind))
            else:
                s = other()
            text += s
        out.append((text + r.choice(["", "", ".", ",", "###", ")"]), spans))
    return out


@functools.cache
def weights(examples: int = 3000, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> dict[str, float]:
    """Fitted by stochastic gradient ascent on the log likelihood: features observed less features expected."""
    w: dict[str, float] = {}
    data = []
    for text, spans in training_regions(examples, seed):
        region = Region(text)
        true = {(a, b, k) for a, b, k in spans}
        segments = _scores(region, {})
        data.append((region, segments, [(region.at[i], region.at[j], k) in true for i, j, k, *_ in segments]))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        step = rate / (1 + epoch)
        for region, segments, gold in data:
            if not segments:
                continue
            scored = [(i, j, k, f, sum(w.get(x, 0.0) for x in f)) for i, j, k, f, _ in segments]
            for (_, _, _, f, _), p, y in zip(scored, _posteriors(region.n, scored), gold, strict=True):
                if abs(gap := y - p) > 1e-4:
                    for x in f:
                        w[x] = w.get(x, 0.0) * (1 - step * decay) + step * gap
    return w


def added_spans(text: str, base: list[Span], w: dict[str, float]) -> list[Span]:
    """What the field adds to the rules' spans."""
    found = []
    for start, piece in regions(text):
        at = [m.start() for m in _TOKEN.finditer(piece)] + [len(piece)]
        free = 0
        for own in range(0, len(at) - 1, REGION_TOKENS):
            first = max(0, own - MARGIN)
            region = Region(piece[at[first] : at[min(own + REGION_TOKENS + MARGIN, len(at) - 1)]])
            segments = _scores(region, w)
            if not segments:
                continue
            sure = _posteriors(region.n, segments)
            for s in sorted(best_segments(region.n, segments), key=lambda s: segments[s][:2]):
                i, j, kind, *_ = segments[s]
                if not own <= first + i < own + REGION_TOKENS or first + i < free:
                    continue
                lo, hi = start + at[first + i], start + at[first + j]
                if sure[s] >= LEAST_POSTERIOR and all(hi <= x or y <= lo for x, y, _ in base):
                    found.append((lo, hi, kind))
                    free = first + j
    return found


def find(text: str, w: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and all spans in order."""
    base = base_spans(text)
    return base, sorted({*base, *added_spans(text, base, w)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans: arrays of (start, end, kind) in code points, end exclusive."""
    id_type, w = docs.schema[id_col].dataType.simpleString(), weights()
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        rows = lambda some: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in some], kind)
        for batch in batches:
            for part in slices(batch):
                found = [find(t or "", w) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), rows([f[0] for f in found]), rows([f[1] for f in found])], ["id", "base", "spans"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns; each span in text_col gives way to its kind in brackets. Where spans overlap, the whole stretch gives way to the first one's."""
    w = weights()

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b, kind in find(text, w)[1]:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part in slices(batch):
                yield part.set_column(k, batch.schema.field(k), pa.array([mask(t) for t in part.column(k).to_pylist()], batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
