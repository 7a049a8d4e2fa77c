"""Facts of order wins in filings: the disclosure form's fields, or else the sentence that speaks most of an order; and how extractions are scored.

A text's labels are all found first; each value runs from its label to where the next field's begins. All of that is done by Spark's own string and array functions; only amounts
are read in Python, for all of a text's candidates in one call.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.extract import amount_outcome, close_to, duration_months, same_counterparty
from epochlens.functions.money import AMOUNTS, find_amounts

# fixed values: the labels of the regulator's disclosure form, the best wording of each field first, as layouts render them
LABELS = {
    "counterparty": [r"name of the (entity|party|customer|company|client) ?(/ ?\w+ ?)?(awarding|from whom|who has (awarded|placed)|to whom)"],
    "terms": [r"significant terms( and conditions)?"],
    "awarded_by": [r"whether (the )?order ?\( ?s ?\) ?/? ?contract ?\( ?s ?\) (have|has) been awarded by"],
    "nature": [r"nature of (the )?order"],
    "domestic": [r"whether domestic or internationa ?l"],
    "period": [r"time period"],
    "size": [r"broad consideration or size", r"\bsize of (the )?order", r"\bvalue of (the )?order\b", r"\border value\b", r"\bcontract value\b"],
    "promoter": [r"whether the promoter"],
    "related": [r"related party transaction", r"fall within related party"],
}
# fixed values: rest of a label that a layout leaves in its value; words of orders, of their value, and of other amounts; the least order, the longest value and quotation
LEFT_OVER = r"(the )?order ?\( ?s ?\) ?/? ?contra ?ct ?\( ?s ?\) ?(is to be executed|awarded,? in brief|have been awarded|;)?|in brief ?;?|be provided|is to be executed ?;?|associated with the ?;?|if any,?|•"
ORDER_WORDS = r"\b(order|contract|letter of (award|acceptance|intent)|loa|loi|tender|bid)"
VALUE_WORDS = r"aggregat|worth|valu|amount|consideration|size|cost|price"
OTHER_AMOUNTS = r"turnover|revenue|net worth|share capital|face value|paid[- ]up|market cap|earnest money|\bemd\b|bank guarantee|security deposit|penalt"
EXPORT, DOMESTIC = r"\b(international|foreign|overseas)\b|\bexport", r"\bdomestic\b"
LEAST_ORDER, LONGEST_VALUE, LONGEST_QUOTE, LONGEST_NAME = 1e5, 400, 1000, 200
ANSWER, HEAD = 60, 30
_EDGE = " :;,.-–•"


def _has(text: Column, words: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + words), F.lit(False))


def _clean(value: Column) -> Column:
    """Without the label's rest, the number of the form's next row and this row's letter."""
    value = F.btrim(F.regexp_replace(F.regexp_replace(value, "(?i)" + LEFT_OVER, " "), r"\s+", " "), F.lit(_EDGE))
    value = F.regexp_replace(value, r"( (\d{1,2}|[a-z])[.)]?)+$", "")
    return F.btrim(F.regexp_replace(value, r"^(\d{1,2}|[a-z])[.)] ", ""), F.lit(_EDGE))


def with_segments(rows: DataFrame, flat: str, out: str, wanted: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """rows with a struct of the wanted fields, each an array of the values after its labels, best wording first. flat: a column of text with single spaces.

    Where a value ends is decided by the best wording found of each field. After a lesser wording, or the last label, a value has LONGEST_VALUE characters at most.
    """
    text = F.col(flat)
    marks = []
    for field, wordings in LABELS.items():
        for rank, wording in enumerate(wordings):
            said = F.regexp_extract(text, "(?i)" + wording, 0)
            marks.append(F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), F.regexp_instr(text, F.lit("(?i)" + wording)).alias("start"), F.length(said).alias("n")))
    rows = rows.withColumn("_found", F.filter(F.array(*marks), lambda m: m["start"] > 0))
    # marks stand in the order of LABELS, a field's best wording first
    firsts = F.filter(F.transform("_found", lambda m, i: F.when((i == 0) | (F.get(F.col("_found"), i - 1)["field"] != m["field"]), m["start"])), lambda s: s.isNotNull())
    rows = rows.withColumn("_stops", firsts)

    def stop(m: Column) -> Column:
        return F.struct(m["field"].alias("field"), m["rank"].alias("rank"), (m["start"] + m["n"]).alias("after"), F.array_min(F.filter("_stops", lambda s: s > m["start"])).alias("following"))

    rows = rows.withColumn("_cuts", F.transform("_found", stop))

    def value(m: Column) -> Column:
        whole = F.coalesce(m["following"], F.length(text) + 1) - m["after"]
        longest = F.when(m["following"].isNull() | (m["rank"] > 0), F.lit(LONGEST_VALUE)).otherwise(whole)
        return F.struct(m["field"].alias("field"), _clean(F.substring(text, m["after"], F.greatest(F.least(whole, longest), F.lit(0)))).alias("value"))

    rows = rows.withColumn("_values", F.transform(F.filter("_cuts", lambda m: m["field"].isin(*wanted)), value))
    of = lambda field: F.transform(F.filter("_values", lambda v: v["field"] == field), lambda v: v["value"])
    return rows.withColumn(out, F.struct(*(of(field).alias(field) for field in wanted))).drop("_found", "_stops", "_cuts", "_values")


def _amounts_of_each(texts: Column) -> Column:
    @F.pandas_udf(f"array<{AMOUNTS}>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [find_amounts(t) if isinstance(t, str) else [] for t in row] for row in texts], dtype=object)

    return find(texts)


def _picked(amounts: Column) -> Column:
    """The first rupee amount that may be an order's value, else the first of another currency."""
    rupees = F.filter(amounts, lambda a: (a["currency"] == "INR") & (a["amount"] >= LEAST_ORDER))
    return F.coalesce(F.get(rupees, F.lit(0)), F.get(F.filter(amounts, lambda a: ~a["currency"].eqNullSafe(F.lit("INR"))), F.lit(0)))


def _counterparty(value: Column) -> Column:
    name = F.trim(F.regexp_replace(value, r"(?i)^(m ?/ ?s\.?|messrs\.?) *", ""))
    return F.when((name != "") & ~F.lower(name).isin("-", "na", "n/a", "not applicable"), F.substring(name, 1, LONGEST_NAME))


def _market(flat: Column, fields: Column, foreign: Column) -> Column:
    """domestic or export by the first answer that says one: right after the question, or in its field; else export only by what the text says of it."""
    first = lambda f: F.coalesce(F.get(fields[f], F.lit(0)), F.lit(""))
    asked = F.regexp_extract_all(flat, F.lit(rf"(?i)whether domestic +or\b(.{{0,{ANSWER}}})"), F.lit(1))
    windows = F.transform(asked, lambda w: F.regexp_replace(w, r"(?i)^(.*?)(internationa ?l ?[;:]?|/ ?international)", "$1 "))
    heads = F.transform(F.concat(windows, F.array(first("domestic"), first("awarded_by"))), lambda w: F.substring(F.btrim(w, F.lit(_EDGE)), 1, HEAD))
    answers = F.transform(heads, lambda h: F.when(_has(h, EXPORT), "export").when(_has(h, DOMESTIC), "domestic"))
    return F.coalesce(F.get(F.filter(answers, lambda a: a.isNotNull()), F.lit(0)), F.when(_has(flat, r"\bexport") | foreign, "export").otherwise("unknown"))


def order_wins(filings: DataFrame, text: str, filed: str) -> DataFrame:
    """filings with ``order``: amount, currency, amount_text, counterparty, market, months, repeat, method (annexure, sentence or none), confidence, evidence and unsure.

    An empty or null text has no facts: method none. A repeat order is true or null, as a text never says that it is none.
    """
    flat = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    rows = with_segments(filings.withColumn("_flat", flat), "_flat", "_f", ("counterparty", "awarded_by", "domestic", "period", "size"))
    flat, fields = F.col("_flat"), F.col("_f")
    sentences = F.filter(F.split(flat, r"(?<=[.;]) (?=[A-Z])"), lambda s: _has(s, ORDER_WORDS) & ~_has(s, OTHER_AMOUNTS))
    rows = rows.withColumn("_s", sentences).withColumn("_a", _amounts_of_each(F.concat(F.array(flat), fields["size"], F.col("_s"))))
    n = F.size(fields["size"])
    pick = lambda texts, amounts: F.filter(F.zip_with(texts, amounts, lambda t, a: F.struct(t.alias("text"), _picked(a).alias("found"))), lambda x: x["found"].isNotNull())
    told = pick(F.col("_s"), F.slice(F.col("_a"), n + 2, F.greatest(F.size("_a") - n - 1, F.lit(0))))
    from_form = F.get(pick(fields["size"], F.slice(F.col("_a"), F.lit(2), n)), F.lit(0))
    from_words = F.coalesce(F.get(F.filter(told, lambda x: _has(x["text"], VALUE_WORDS)), F.lit(0)), F.get(told, F.lit(0)))
    rows = rows.withColumn("_form", from_form).withColumn("_words", from_words)
    one = F.coalesce("_form", "_words")
    method = F.when(F.col("_form").isNotNull(), "annexure").when(F.col("_words").isNotNull(), "sentence").otherwise("none")
    confidence = F.when(method == "annexure", 0.9).when(method == "sentence", 0.7).otherwise(0.2)
    foreign = F.exists(F.col("_a")[0], lambda a: F.coalesce(a["currency"] != "INR", F.lit(False)))
    order = F.struct(
        one["found"]["amount"].alias("amount"), one["found"]["currency"].alias("currency"), one["found"]["text"].alias("amount_text"), _counterparty(F.get(fields["counterparty"], F.lit(0))).alias("counterparty"),
        _market(flat, fields, foreign).alias("market"), duration_months(F.get(fields["period"], F.lit(0)), F.col(filed)).alias("months"), F.when(_has(flat, r"\brepeat order"), F.lit(True)).alias("repeat"),
        method.alias("method"), confidence.alias("confidence"), F.substring(F.btrim(one["text"]), 1, LONGEST_QUOTE).alias("evidence"), (confidence < 0.6).alias("unsure"),
    )
    return rows.withColumn("order", order).drop("_flat", "_f", "_s", "_a", "_form", "_words")


def scores(labels: DataFrame, predictions: DataFrame, methods: DataFrame, key: str) -> DataFrame:
    """Of each method, over all labelled new orders and apart by whether its own proposal was shown to the labeller: n, and how many of each field are right, amounts abstained from and wrong.

    labels: key, status, kind, shown, amount, currency, counterparty, market, months, repeat. predictions: key, method and the same facts; a filing that a method says nothing of counts as all empty.
    methods: method, those to be judged.
    """
    facts = ["amount", "currency", "counterparty", "market", "months", "repeat"]
    asked = labels.where("status = 'labelled' and kind = 'new_order'").select(key, "shown", *(F.col(c).alias(f"w_{c}") for c in facts)).crossJoin(F.broadcast(methods.select("method").distinct()))  # a handful of methods
    said = predictions.select(key, "method", *facts)
    both = asked.join(said, [key, "method"], "left").withColumn("market", F.coalesce("market", F.lit("unknown")))
    outcome = amount_outcome(F.col("amount"), F.col("currency"), F.col("w_amount"), F.col("w_currency"))
    right = {
        "amount": outcome == "correct", "abstained": outcome == "abstained", "wrong_amount": outcome == "wrong", "counterparty": same_counterparty(F.col("counterparty"), F.col("w_counterparty")), "market": F.col("market").eqNullSafe(F.col("w_market")),
        "months": close_to(F.col("months"), F.col("w_months"), 0.10, 0.5), "repeat": F.col("repeat").eqNullSafe(F.col("w_repeat")),
    }
    judged = both.withColumn("shown_own", F.col("shown").eqNullSafe(F.col("method")))
    counted = judged.groupBy("method", "shown_own").agg(F.count("*").alias("n"), *(F.count_if(x).alias(k) for k, x in right.items()))
    whole = counted.groupBy("method").agg(*(F.sum(c).alias(c) for c in ("n", *right))).withColumn("shown_own", F.lit(None).cast("boolean"))
    return counted.unionByName(whole)
