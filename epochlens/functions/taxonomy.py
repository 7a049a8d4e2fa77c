"""Rule classifier: ordered rules, given as data, compiled into one Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "OTHER"


def _clause(clause: dict, columns: dict[str, Column]) -> Column:
    """All conditions of a clause hold. A column's condition is a list of values; text and not_text are regular expressions over the text."""
    parts = []
    for name, wanted in clause.items():
        if name == "text":
            parts.append(columns["text"].rlike(f"(?i){wanted}"))
        elif name == "not_text":
            parts.append(~columns["text"].rlike(f"(?i){wanted}"))
        else:
            values = wanted if isinstance(wanted, list) else [wanted]
            parts.append(F.lower(columns[name]).isin([v.lower() for v in values]))
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def compile_rules(rules: list[dict], generic: list[dict], columns: dict[str, Column]) -> Column:
    """struct(event_type, rule_no): the first rule of which a clause holds; rules marked generic_only need a generic clause to hold too."""
    is_generic = F.lit(False)
    for g in generic:
        is_generic = is_generic | _clause(g, columns)
    out = None
    for n, rule in enumerate(rules):
        holds = F.lit(False)
        for clause in rule["when"]:
            holds = holds | _clause(clause, columns)
        if rule.get("generic_only"):
            holds = holds & is_generic
        value = F.struct(F.lit(rule["type"]).alias("event_type"), F.lit(n).alias("rule_no"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    other = F.struct(F.lit(OTHER).alias("event_type"), F.lit(len(rules)).alias("rule_no"))
    return other if out is None else out.otherwise(other)


def tier(event_type: Column, containers: list[str], noise: list[str]) -> Column:
    """Specific types over containers over noise over OTHER."""
    return F.when(event_type == OTHER, 0).when(event_type.isin(noise), 1).when(event_type.isin(containers), 2).otherwise(3)


def best_of_group(typed: DataFrame, group: str, containers: list[str], noise: list[str]) -> DataFrame:
    """The best type among a group's members: highest tier, then lowest rule number."""
    return typed.groupBy(group).agg(F.max_by("event_type", F.struct(tier(F.col("event_type"), containers, noise), -F.col("rule_no"))).alias("event_type"), F.count("*").alias("filings"))


def coverage(typed: DataFrame, noise: list[str]) -> DataFrame:
    """Rows of each type, and the share of OTHER among all that aren't noise."""
    counts = typed.groupBy("event_type").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum(F.when(F.col("event_type") == OTHER, F.col("n")).otherwise(0)).alias("_o"), F.sum(F.when(~F.col("event_type").isin(noise), F.col("n")).otherwise(0)).alias("_t"))
    return counts.crossJoin(F.broadcast(whole)).select("event_type", "n", (F.col("_o") / F.nullif(F.col("_t"), F.lit(0))).alias("other_share"))  # one row


def attachment_words(name: Column, symbol: Column) -> Column:
    """Words of an attachment's file name: without extension, symbol and long digit runs, camel case apart."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    bare = F.regexp_replace(F.replace(stem, F.coalesce(symbol, F.lit("\0")), F.lit(" ")), r"\d{6,}", " ")
    apart = F.regexp_replace(bare, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(apart, r"[^A-Za-z0-9]+", " "))
