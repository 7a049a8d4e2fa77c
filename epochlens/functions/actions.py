"""Corporate actions: what a subject line says about prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_BONUS = rf"(?i)bonus[^0-9]*{_NUMBER}\s*:\s*{_NUMBER}"
_SPLIT = rf"(?i)(?:split|sub-?\s?division)[^0-9]*{_NUMBER}[^0-9]+{_NUMBER}"
_CASH = rf"(?i)dividend[^0-9;+&]*?(?:rs\.?|re\.?|inr)\s*{_NUMBER}"
_REVIEW = r"(?i)rights|demerger|scheme|amalgamation|capital reduction|bonus.*(debenture|preference|ncrps)"


def classify(subject: Column) -> Column:
    """struct(kind, multiplier, cash, review): a bonus of a for b multiplies by (a + b) / b, a split by old over new face value; dividends are added up."""
    number = lambda p, k: F.regexp_extract(subject, p, k).try_cast("double")
    review = subject.rlike(_REVIEW)
    bonus = F.when(subject.rlike(_BONUS) & ~review, F.try_divide(number(_BONUS, 1) + number(_BONUS, 2), number(_BONUS, 2)))
    split = F.when(subject.rlike(_SPLIT), F.try_divide(number(_SPLIT, 1), number(_SPLIT, 2)))
    cash = F.aggregate(F.transform(F.regexp_extract_all(subject, F.lit(_CASH), F.lit(1)), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    kind = F.when(review, "review").when(bonus.isNotNull() & split.isNotNull(), "bonus_split").when(bonus.isNotNull(), "bonus").when(split.isNotNull(), "split").when(cash > 0, "dividend").otherwise("other")
    return F.struct(kind.alias("kind"), (F.coalesce(bonus, F.lit(1.0)) * F.coalesce(split, F.lit(1.0))).alias("multiplier"), cash.alias("cash"), review.alias("review"))


def adjustments(actions: DataFrame, symbol: str, ex_date: str, subject: str) -> DataFrame:
    """Per symbol and ex-date the product of multipliers, whether any needs review, and the subjects."""
    a = actions.withColumn("_a", classify(F.col(subject)))
    return a.groupBy(symbol, ex_date).agg(F.product("_a.multiplier").alias("multiplier"), F.bool_or("_a.review").alias("review"), F.sort_array(F.collect_list(subject)).alias("subjects"))


def split_safe_return(close: Column, previous: Column, multiplier: Column) -> Column:
    return F.when(previous > 0, F.try_divide(close * F.coalesce(multiplier, F.lit(1.0)), previous) - 1)
