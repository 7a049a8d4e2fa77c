"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset of exchange time from UTC.
IST = "+05:30"
# fixed values: texts that stand for "no value", and the layouts of dates and times that occur
EMPTY = ["", "-", "--", "na", "n/a", "nil", "none", "null"]
DATE_FORMATS = ["dd-MMM-yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy", "yyyyMMdd"]
TIME_FORMATS = ["dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "ddMMyyyyHHmmss"]


def r6(x: Column) -> Column:
    """Rounded to six places, halves up."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def ordered_sum(value: str, *order: str) -> Column:
    """Aggregate of a few rows: the sum of doubles, added up in this order, so that its last bit, and what lies on an edge, doesn't hang on how rows are dealt over tasks. Null without any value."""
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda total, x: total + x["_v"]))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def clean_text(x: Column) -> Column:
    """White space collapsed; texts that stand for no value are null."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(~F.lower(flat).isin(EMPTY), flat)


def folded(record: Column) -> Column:
    """The map with trimmed keys in lower case, for ``picked``."""
    return F.transform_keys(record, lambda k, _: F.lower(F.trim(k)))


def picked(record: Column, *keys: str) -> Column:
    """First non-empty of several keys of a folded map, whatever their case."""
    return F.coalesce(*(clean_text(F.try_element_at(record, F.lit(k.lower()))) for k in keys))


def pick(record: Column, *keys: str) -> Column:
    """First non-empty of several keys of a map, whatever their case. Of many fields of a record: ``folded`` once, then ``picked``."""
    return once(folded(record), lambda r: picked(r, *keys))


def to_number(x: Column) -> Column:
    """A double; thousands separators are dropped, unreadable texts are null."""
    return F.replace(clean_text(x), F.lit(","), F.lit("")).try_cast("double")


def to_whole(x: Column) -> Column:
    """A long, halves to even."""
    return F.bround(to_number(x)).cast("long")


def _titled(x: Column) -> Column:
    return F.regexp_replace(F.initcap(F.lower(x)), "T(?=[0-9])", "T")


def _like(layout: str) -> str:
    """A pattern that all texts of a layout match: a layout that is tried in vain costs as much as many patterns."""
    shapes = {"dd": r"\d\d", "MMM": r"\D+", "MM": r"\d\d", "yyyy": r"[+-]?\d{4,}", "HH": r"\d\d", "mm": r"\d\d", "ss": r"\d\d", "SSS": r"\d+", "'T'": "[Tt]", ".": r"\."}
    return "^" + re.sub(r"dd|MMM|MM|yyyy|HH|mm|ss|SSS|'T'|\.", lambda m: shapes[m[0]], layout) + "$"


def _read(x: Column, layouts: list[str]) -> list[Column]:
    return [F.when(x.rlike(_like(f)), F.try_to_timestamp(_titled(x), F.lit(f))) for f in layouts]


def parse_date(x: Column) -> Column:
    return once(clean_text(x), lambda t: F.coalesce(*(F.to_date(read) for read in _read(t, DATE_FORMATS))))


def parse_exchange_time(x: Column) -> Column:
    """An instant: texts with an offset as they say, others in exchange time."""
    offset = lambda t: F.when(t.rlike(r"([+-]\d\d:?\d\d|[Zz])$"), F.try_to_timestamp(t))
    return once(clean_text(x), lambda t: F.coalesce(offset(t), *(F.to_utc_timestamp(read, IST) for read in _read(t, TIME_FORMATS))))


def exchange_date(ts: Column) -> Column:
    """The exchange's calendar date of an instant, which is not UTC's."""
    return F.to_date(F.from_utc_timestamp(ts, IST))


def exchange_instant(day: Column, clock: str | Column) -> Column:
    """The instant of a wall-clock time (HH:mm) on an exchange day."""
    clock = F.lit(clock) if isinstance(clock, str) else clock
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), clock), "yyyy-MM-dd HH:mm"), IST)


def available_at(mode: Column, event_ts: Column, fetched_at: Column) -> Column:
    """When a record could first be known: backfilled ones when they happened, others not before they were fetched."""
    return F.when(mode == "backfill", event_ts).otherwise(F.greatest(fetched_at, event_ts))


def effective_availability(available: Column, event_ts: Column, disseminated: Column, delay_s: int = 60) -> Column:
    """Records of whole minutes without a dissemination time become known a delay later, and never before they are recorded as available."""
    whole = disseminated.isNull() & (F.second(event_ts) == 0)
    return F.when(whole, F.greatest(available, event_ts + F.make_dt_interval(secs=F.lit(delay_s)))).otherwise(available)


def display_size(x: Column) -> Column:
    """Bytes of "165.57 KB"; zero is null."""
    number = F.regexp_extract(x, r"(?i)^\s*([0-9.,]+)\s*(bytes|kb|mb|gb|b)\s*$", 1)
    unit = F.upper(F.regexp_extract(x, r"(?i)^\s*([0-9.,]+)\s*(bytes|kb|mb|gb|b)\s*$", 2))
    scale = F.when(unit == "KB", 1024.0).when(unit == "MB", 1024.0**2).when(unit == "GB", 1024.0**3).otherwise(1.0)
    value = to_number(number) * scale
    return F.when(value > 0, F.floor(value + 0.5).cast("long"))


def signed_duration(x: Column) -> Column:
    """Seconds of a signed HH:MM:SS."""
    parts = F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))
    total = F.try_element_at(parts, F.lit(1)).cast("long") * 3600 + F.try_element_at(parts, F.lit(2)).cast("long") * 60 + F.try_element_at(parts, F.lit(3)).cast("long")
    return F.when(x.rlike(r"^\s*-?\d+:\d\d:\d\d\s*$"), F.when(F.trim(x).startswith("-"), -total).otherwise(total))


def band_fraction(x: Column) -> Column:
    return x.try_cast("double") / 100


def bucket(x: Column, edges: list[float]) -> Column:
    """Index of the last edge that is not over x; -1 below the first."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) - 1


def wants_attachment(texts: Column, include: list[str], exclude: list[str]) -> Column:
    """Keyword policy: an excluded word wins; without included words all are wanted."""
    flat = F.lower(F.concat_ws(" ", texts))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(flat, F.lower(w))) if words else F.lit(False)
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a share."""
    p, zz = F.try_divide(k, n), z * z  # of nothing no share is known
    n = F.nullif(n, F.lit(0))
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def period(day: Column, train_end: str, test_start: str) -> Column:
    """train, test, or null in the gap between them."""
    return F.when(day <= F.lit(train_end).cast("date"), "train").when(day >= F.lit(test_start).cast("date"), "test")


def tax_category(product: Column, opened: Column, closed: Column) -> Column:
    """Intraday trades are speculative; others are long term when held for more than twelve months."""
    return F.when(product == "intraday", "speculative").when(closed > F.add_months(opened, 12), "long_term").otherwise("short_term")


def path_name(key: Column) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9._-]+", "_")


def size_agreement(exact: Column, shown: Column) -> Column:
    """kb or mb: a size in bytes agrees with a shown one to its second place in that unit; no; null if either is unknown."""
    close = lambda unit: F.abs(exact / unit - shown / unit) <= 0.005 + 1 / unit
    return F.when(exact.isNull() | shown.isNull(), None).when(close(1024.0), "kb").when(close(1024.0**2), "mb").otherwise("no")


def topic_tokens(text: Column, name: Column, stop: list[str]) -> Column:
    """Distinct lower-case words over two letters, without stop words and the name's own; a final s goes from those over four."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    own = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    left = F.filter(F.array_except(words, F.array_union(own, F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(left, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def pair_score(size: Column, gap_s: Column, similarity: Column) -> Column:
    """Points for agreeing sizes, for closeness in time, and three times the similarity of topics."""
    return F.when(size == "kb", 3.0).when(size == "mb", 2.0).when(size == "no", -1.0).otherwise(0.0) + F.when(gap_s <= 900, 2.0).when(gap_s <= 7200, 1.0).otherwise(0.0) + 3 * similarity


def order_state(state: Column, event: Column) -> Column:
    """The next state of an order, null for an event that its state doesn't allow."""
    moves = {("new", "accept"): "open", ("new", "reject"): "rejected", ("open", "fill"): "filled", ("open", "part"): "partial", ("partial", "part"): "partial", ("partial", "fill"): "filled", ("open", "cancel"): "cancelled", ("partial", "cancel"): "cancelled", ("new", "cancel"): "cancelled"}
    out = F.lit(None).cast("string")
    for (s, e), to in moves.items():
        out = F.when((state == s) & (event == e), to).otherwise(out)
    return out


def refusal_reason(note: Column) -> Column:
    """The part of a refusal's note before its figures."""
    return F.trim(F.split(note, "[:(]").getItem(0))
