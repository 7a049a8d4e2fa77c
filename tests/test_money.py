"""Amounts in filings: phrasings written for these tests, amounts worked out by hand, and more made from numbers."""

from __future__ import annotations

import random

import pytest

from epochlens.functions.money import SCALES, SMALL, TENS, find_amounts, words_to_number


@pytest.mark.parametrize(
    ("text", "amount", "currency"),
    [
        ("a purchase of Rs 45,67,890", 4_567_890, "INR"),  # Indian groups
        ("Rs.3,456,789.25 in all", 3_456_789.25, "INR"),  # Western groups
        ("valued at ₹ 1,25,000/- today", 125_000, "INR"),
        ("INR 7.5 lakhs", 750_000, "INR"),
        ("about 31 crores of work", 310_000_000, "INR"),  # the unit alone says rupees
        ("a sum of 0.85 million", 850_000, None),  # it doesn't here
        ("rupees 640 thousand", 640_000, "INR"),
        ("Rs. 2, 415 crore", 24_150_000_000, "INR"),  # a layout's space after a comma, before a unit
        ("between Rs. 40 - 55 lakh", 4_000_000, "INR"),  # the lower end of a range
        ("between USD 3 to 4 bn", 3e9, "USD"),
        ("US $ 66.5 mio", 66_500_000, "USD"),
        ("£12,500", 12_500, "GBP"),
        ("EUR 0.9 billion", 9e8, "EUR"),
        ("aed 480,000", 480_000, "AED"),
        ("8 lac(s)", 800_000, "INR"),
    ],
)
def test_one_amount(text, amount, currency):
    (found,) = find_amounts(text)
    assert found["amount"] == pytest.approx(amount) and found["currency"] == currency
    assert text[found["start"] :].startswith(found["text"])


@pytest.mark.parametrize("text", ["", "no figures at all", "orders 12 of them", "code AB12C3456 crore", "on 14.08.2025 at 10.30", "scrip 500325", "Rs. only"])
def test_none(text):
    assert find_amounts(text) == []


def test_lists_and_overlaps():
    # a list stays apart: only its last member runs into the unit
    assert [a["amount"] for a in find_amounts("Rs. 15, 25 and 40 lakh")] == [15, 4e6]
    # one amount in two currencies, and one in figures and in words
    assert [(a["amount"], a["currency"]) for a in find_amounts("Rs. 83 crore (about US$ 10 million)")] == [(8.3e8, "INR"), (1e7, "USD")]
    both = find_amounts("Rs. 1,05,000/- (Rupees One Lakh Five Thousand only)")
    assert [a["amount"] for a in both] == [105_000, 105_000] and both[0]["start"] < both[1]["start"]


@pytest.mark.parametrize(
    ("text", "amount"),
    [
        ("Seven Crore Forty Lakh", 74_000_000),
        ("nine hundred twelve", 912),
        ("Two Thousand Three Hundred and Eleven Rupees", 2_311),
        ("Sixty & Four Lakhs", 6_400_000),
        ("three lakh crore", 3e12),  # a scale multiplies what was said before it
        ("twelve and paise fifty", 12.50),  # paise after their word
        ("forty and thirty-five paise", 40.35),  # and before it
        ("five paise", 0.05),
        ("Eigh ty Thousand", 80_000),  # a word that a layout broke
        ("Eleventy Lakh", None),  # no such word: nothing is guessed
        ("crore", None),
        ("ten and paise one hundred", None),
        ("", None),
    ],
)
def test_words(text, amount):
    assert words_to_number(text) == (None if amount is None else pytest.approx(amount))


def said(n: int) -> str:
    """A number below a hundred crore in Indian words."""
    small, tens = {v: w for w, v in SMALL.items()}, {v: w for w, v in TENS.items()}

    def below_hundred(k: int) -> str:
        return small[k] if k < 20 else tens[k // 10 * 10] + ("-" + small[k % 10] if k % 10 else "")

    out = []
    for scale in ("crore", "lakh", "thousand"):
        k, n = divmod(n, SCALES[scale])
        out += [below_hundred(k), scale] if k else []
    k, n = divmod(n, 100)
    out += [small[k], "hundred"] if k else []
    return " ".join(out + ([below_hundred(n)] if n or not out else []))


def grouped(n: int) -> str:
    """Indian grouping: the last three digits, then pairs."""
    digits = str(n)
    head, tail = digits[:-3], digits[-3:]
    pairs = [head[max(0, i - 2) : i] for i in range(len(head), 0, -2)][::-1]
    return ",".join([*pairs, tail])


@pytest.mark.parametrize("seed", range(20))
def test_figures_and_words_of_one_number(seed):
    n = random.Random(seed).randrange(1, 10 ** (seed % 9 + 1))
    assert words_to_number(said(n).title()) == n
    both = find_amounts(f"a contract of Rs. {grouped(n)}/- (Rupees {said(n)} only) was won")
    assert [(a["amount"], a["currency"]) for a in both] == [(n, "INR"), (n, "INR")]
