"""Facts of order wins in filings as people write them, and their scores."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from epochlens.functions import extract, orders

FORM = (
    "Annexure I  1. Name of the entity awarding the order(s)/contract(s); M/s Blue River Works Pvt. Ltd. 2. Significant terms and conditions of order(s)/contract(s) awarded in brief; As per letter of award "
    "3. Whether order(s)/contract(s) have been awarded by domestic/ international entity; Domestic entity 4. Nature of order(s)/contract(s); Supply 5. Whether domestic or international; Domestic "
    "6. Time period by which the order(s)/contract(s) is to be executed; 14 months 7. Broad consideration or size of the order(s)/contract(s); Rs. 42.5 crore plus GST "
    "8. Whether the promoter/promoter group have any interest; No 9. Whether the order(s) would fall within related party transactions; No"
)
FILED = date(2026, 1, 1)


@pytest.fixture(scope="module")
def read(spark):
    def one(*texts):
        rows = spark.createDataFrame([(i, t, FILED) for i, t in enumerate(texts)], "i int, text string, filed date")
        return [r["order"] for r in orders.order_wins(rows, "text", "filed").orderBy("i").collect()]

    return one


def test_a_form(read):
    (found,) = read(FORM)
    assert (found["amount"], found["currency"], found["amount_text"]) == (pytest.approx(4.25e8), "INR", "Rs. 42.5 crore")
    assert found["counterparty"].startswith("Blue River Works Pvt. Ltd")
    assert (found["market"], found["months"], found["repeat"], found["method"], found["confidence"], found["unsure"]) == ("domestic", 14.0, None, "annexure", 0.9, False)
    assert found["evidence"].startswith("of") or "42.5" in found["evidence"]


def test_what_forms_leave_out(read):
    blank, letter, garbled, foreign, nothing, empty, null = read(
        FORM.replace("Rs. 42.5 crore plus GST", "As stated above").replace("M/s Blue River Works Pvt. Ltd.", "N/A"),
        "We have a turnover of Rs. 950 crore. The order is for 10 units. The Company won a contract worth Rs 7 crore. Another order of Rs 9 crore is awaited.",
        "Broad consideration or size of the order(s)/contract(s) Rs 20 Whether the promoter No. The contract value is INR 3,50,00,000/- in all.",
        "A letter of intent valued at USD 12 million was received from an overseas buyer",
        "The order book is strong and the price was 5.",
        "",
        None,
    )
    assert (blank["amount"], blank["method"], blank["counterparty"]) == (None, "none", None)
    # a sentence that speaks of a value goes before one that only names an order, and a turnover is no order
    assert (letter["amount"], letter["method"], letter["evidence"]) == (7e7, "sentence", "The Company won a contract worth Rs 7 crore.")
    # too small for an order: the looser label has it
    assert (garbled["amount"], garbled["method"]) == (3.5e7, "annexure")
    assert (foreign["amount"], foreign["currency"], foreign["market"]) == (1.2e7, "USD", "export")
    for x in (nothing, empty, null):
        assert (x["amount"], x["method"], x["confidence"], x["unsure"], x["market"], x["months"]) == (None, "none", 0.2, True, "unknown", None)


def test_domestic_or_export(read):
    asked = "Whether domestic or international"
    found = read(f"{asked} Domestic", f"{asked}: International", f"{asked} ; overseas order", "Whether domestic or Domestic internationa l 4", f"{asked} see above", "an exporter's order", "order for the foreign minister")
    assert [x["market"] for x in found] == ["domestic", "export", "export", "domestic", "unknown", "export", "unknown"]


def test_repeat_and_long_values(read):
    far = "Order value " + "x " * 260 + "Rs 5 crore"
    again, cut, many = read("This is a repeat order worth Rs 2 crore.", far, " ".join([FORM] * 30))
    assert again["repeat"] is True
    assert (cut["amount"], cut["method"]) == (5e7, "sentence")  # too far behind its label, but in a sentence
    assert many["amount"] == pytest.approx(4.25e8) and len(many["counterparty"]) <= orders.LONGEST_NAME


@pytest.mark.parametrize(
    ("text", "months"),
    [
        ("within 9 months", 9.0), ("2.5 years", 30.0), ("3 yrs from now", 36.0), ("45 days", 1.48), ("6 Weeks", 1.38), ("0 days", None), ("51 years", None), ("soon", None), (None, None),
        ("by December 31, 2026", 12.0), ("before Sept. 5th 2026", 8.1), ("31.03.2027", 14.9), ("1/4/2026", 3.0), ("on the 1st of things, 2 February, 2026", 1.1), ("Marchfield 3, 2027", None), ("32.01.2027", None), ("29 Feb 2027", None), ("June 1, 2025", None),
    ],
)
def test_durations(spark, text, months):
    row = spark.createDataFrame([(text, FILED)], "text string, filed date").select(extract.duration_months(F.col("text"), F.col("filed")).alias("m")).first()
    assert row["m"] == (None if months is None else pytest.approx(months))


def test_scores(spark):
    labels = [(1, "labelled", "new_order", "rules", 100.0, "INR", "Acme Ltd", "domestic", 10.0, None), (2, "labelled", "new_order", "other", None, None, None, "unknown", None, None), (3, "labelled", "update", "rules", 5.0, "INR", None, "unknown", None, None), (4, "open", "new_order", "rules", 5.0, "INR", None, "unknown", None, None), (5, "labelled", "new_order", "rules", 50.0, "INR", "Beta", "export", 24.0, True)]
    said = [(1, "rules", 100.5, "INR", "The Acme Company", "domestic", 10.9, None), (2, "rules", 7.0, "INR", None, "unknown", None, None)]
    schema = "amount double, currency string, counterparty string, market string, months double, repeat boolean"
    found = orders.scores(spark.createDataFrame(labels, f"k int, status string, kind string, shown string, {schema}"), spark.createDataFrame(said, f"k int, method string, {schema}"), spark.createDataFrame([("rules",), ("silent",)], "method string"), "k")
    rows = {(r["method"], r["shown_own"]): r for r in found.collect()}
    whole = rows["rules", None]
    assert (whole["n"], whole["amount"], whole["wrong_amount"], whole["abstained"]) == (3, 1, 1, 1)
    assert (whole["counterparty"], whole["market"], whole["months"], whole["repeat"]) == (2, 2, 2, 2)
    assert rows["rules", True]["n"] == 2 and rows["rules", False]["n"] == 1
    assert (rows["silent", None]["n"], rows["silent", None]["amount"], rows["silent", None]["abstained"]) == (3, 1, 2)
