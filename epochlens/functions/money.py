"""Amounts of money in running text: figures with Indian or Western units, and amounts in words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units of money, those that only rupees are counted in, marks of currencies, and number words
UNITS = {"thousand": 1e3, "lakh": 1e5, "lac": 1e5, "million": 1e6, "mn": 1e6, "mio": 1e6, "crore": 1e7, "cror": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9}
RUPEE_UNITS = {"lakh", "lac", "crore", "cror", "cr"}
CURRENCIES = {"INR": ["rupees", "rs.", "rs", "inr", "₹"], "USD": ["us$", "us $", "usd", "$"], "EUR": ["eur", "€"], "GBP": ["gbp", "£"], "AED": ["aed"]}
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 10**3, "lakh": 10**5, "lac": 10**5, "million": 10**6, "crore": 10**7, "billion": 10**9}

_UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?:s|\(s\))?(?![A-Za-z0-9])"
_MARK = "|".join(re.escape(m) for m in sorted((m for ms in CURRENCIES.values() for m in ms), key=len, reverse=True))
#: Figures: groups of digits; a comma with a space after it joins two groups only if the whole runs into a unit.
_LOOSE = rf"[0-9]+(?:,\s?[0-9]{{2,3}})+(?:\.[0-9]+)?(?=,?\s*{_UNIT})"
_TIGHT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_UPPER = r"(?:\s*(?:-|–|to)\s*[0-9][0-9,]*(?:\.[0-9]+)?)?"
_AMOUNT = re.compile(
    rf"(?:(?<![A-Za-z])(?P<mark>{_MARK})\s*|(?<![\w.,]))(?P<figure>{_LOOSE}|{_TIGHT}){_UPPER}(?P<slash>\s*/-)?\s*(?P<unit>{_UNIT})?", re.IGNORECASE
)
_DIGITS = re.compile(r"[0-9]+")
_LONGEST_MARK = max(len(m) for ms in CURRENCIES.values() for m in ms)
_WORDS = re.compile(r"(?<![A-Za-z])(?:rupees|rs\.?|inr)\s+([a-z][a-z\s&,-]{0,250}?)\s*\bonly\b", re.IGNORECASE)
_KNOWN = {*SMALL, *TENS, *SCALES, *(f"{s}s" for s in SCALES), "hundred", "and", "rupees", "rupee", "paise", "paisa"}


def _words_of(text: str) -> list[str] | None:
    """Known words; a word that a layout broke in two is put together again. None if any is unknown."""
    raw = [w for w in re.split(r"[^a-z]+", text.lower()) if w]
    out, k = [], 0
    while k < len(raw):
        if raw[k] in _KNOWN:
            out.append(raw[k])
            k += 1
        elif k + 1 < len(raw) and raw[k] + raw[k + 1] in _KNOWN:
            out.append(raw[k] + raw[k + 1])
            k += 2
        else:
            return None
    return [w for w in out if w != "and"]


def _whole(words: list[str]) -> tuple[int, int] | None:
    """The number that the words say, and of it the part below a hundred said last; None if they say none.

    A scale multiplies what was said since the last larger one: one lakh twenty thousand crore is 1.2 lakh crore.
    """
    said: list[tuple[int, int]] = []  # value and scale, scales falling
    group, last, open_ = 0, 0, False
    for w in words:
        if w in SMALL or w in TENS:
            value = SMALL.get(w, TENS.get(w, 0))
            group, last, open_ = group + value, (last if w in SMALL and last in TENS.values() else 0) + value, True
        elif w == "hundred":
            if not open_:
                return None
            group, last = group * 100, 0
        else:
            scale = SCALES[w.removesuffix("s")]
            below = 0
            while said and said[-1][1] < scale:
                below += said.pop()[0]
                open_ = True
            if not open_:
                return None
            said.append(((below + group) * scale, scale))
            group, last, open_ = 0, 0, False
    return (sum(v for v, _ in said) + group, last) if said or open_ else None


def words_to_number(text: str) -> float | None:
    """Rupees of an amount in words; null if a word is none of them. Paise stand after their number (which is below a hundred) or before it."""
    words = _words_of(text)
    if not words:
        return None
    at = next((k for k, w in enumerate(words) if w in ("paise", "paisa")), None)
    paise = 0
    if at is not None and at + 1 < len(words):
        found = _whole([w for w in words[at + 1 :] if w not in ("rupees", "rupee")])
        if found is None or found[0] > 99:
            return None
        paise, words = found[0], words[:at]
    elif at is not None:
        found = _whole([w for w in words[:at] if w not in ("rupees", "rupee")])
        if found is None:
            return None
        return found[0] - found[1] + found[1] / 100
    found = _whole([w for w in words if w not in ("rupees", "rupee")])
    return None if found is None else found[0] + paise / 100


def _figures(text: str) -> Iterator[re.Match]:
    """The matches of _AMOUNT, first to last, none over another: each has its figure at the first of some digits, so that only there and at a mark right before is it tried."""
    end, digits = 0, _DIGITS.search(text)
    while digits:
        at = after = digits.start()
        while after > end and text[after - 1].isspace():
            after -= 1
        for start in (*range(max(end, after - _LONGEST_MARK), after), at):
            if m := _AMOUNT.match(text, start):
                yield m
                end = m.end()
                break
        digits = _DIGITS.search(text, max(end, digits.end()))


def find_amounts(text: str) -> list[dict]:
    """amount, currency (null where the text doesn't say) and text of each amount, first to last; of overlapping ones the first stays, of a range the lower end."""
    found = []
    for m in _figures(text):
        mark, unit = (m["mark"] or "").lower(), re.sub(r"(s|\(s\))$", "", (m["unit"] or "").lower())
        if not mark and not unit:
            continue
        currency = next((c for c, marks in CURRENCIES.items() if mark in marks), None) if mark else "INR" if unit in RUPEE_UNITS else None
        found.append((m.start(), m.end(), float(re.sub(r"[,\s]", "", m["figure"])) * UNITS.get(unit, 1.0), currency))
    for m in _WORDS.finditer(text) if "only" in text.lower() else ():
        if (value := words_to_number(m[1])) is not None:
            found.append((m.start(), m.end(), value, "INR"))
    out, end = [], 0
    for a, b, amount, currency in sorted(found, key=lambda f: f[:2]):
        if a >= end:
            out.append({"amount": amount, "currency": currency, "text": text[a:b].rstrip(), "start": a})
            end = b
    return out


AMOUNTS = "array<struct<amount:double,currency:string,text:string,start:int>>"


def amounts(text: Column) -> Column:
    """find_amounts as a column."""

    @F.pandas_udf(AMOUNTS)
    def find(text: pd.Series) -> pd.Series:
        return pd.Series([find_amounts(t) if isinstance(t, str) else None for t in text], dtype=object)

    return find(text)


def amounts_in_context(text: Column, width: int) -> Column:
    """before, amount and after of each."""
    return F.transform(amounts(text), lambda a: F.struct(F.substring(text, F.greatest(F.lit(1), a["start"] + 1 - width), F.least(F.lit(width), a["start"])).alias("before"), a["text"].alias("amount"), F.substring(text, a["start"] + F.length(a["text"]) + 1, F.lit(width)).alias("after")))
