"""Symbols as they were known: who held which symbol when, walked back and forward from a day on which the holder is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.scalars import exchange_instant
from epochlens.operators.asof import asof_join
from epochlens.operators.merge import insert_ignore
from epochlens.session import materialised


def record_changes(store: DataFrame, found: DataFrame, fetched_at: Column) -> DataFrame:
    """The store of changes (old, new, effective, available_at) with those of a file that it doesn't have.

    A change is announced before it takes effect: it could be known from midnight of its day in exchange time, or from when it was first seen if that was earlier.
    """
    known = F.least(fetched_at.cast("timestamp"), exchange_instant(F.col("effective"), "00:00"))
    return insert_ignore(store, found.select("old", "new", "effective", known.alias("available_at")), ["old", "new", "effective"], ["available_at"])


def _paths(changes: DataFrame, back: bool) -> DataFrame:
    """changes (id, old, new, at) with ``path``: the change itself, the one that leads on from it, and so on, by doubling: log2 of the longest chain rounds.

    Back from a change leads the latest one into its old symbol before it, forward the earliest one out of its new symbol after it; days only fall (rise) along a path, so that none comes round.
    """
    on, other = ("old", "new") if back else ("new", "old")
    named = changes.select("id", "old", "new", "at", F.col(on).alias("_k"))
    others = changes.select(F.col(other).alias("_k"), F.col("at").alias("_at"), F.col("id").alias("up"))
    linked = asof_join(named, others, by=["_k"], left_ts="at", right_ts="_at", take=["up"], direction="backward" if back else "forward", allow_equal=False)
    now = materialised(linked.select("id", "up", F.array(F.struct("at", "old", "new")).alias("path")), "paths")
    while now.where("up is not null").limit(1).count():
        ups = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        now = materialised(now.join(ups, "up", "left").select("id", F.col("_up").alias("up"), F.concat("path", F.coalesce("_path", F.slice("path", 1, 0))).alias("path")), "paths")
    return now.select("id", "path")


def _known(changes: DataFrame, as_of: Column | None) -> DataFrame:
    seen = changes.where(F.col("available_at") <= as_of) if as_of is not None else changes
    real = seen.where("old <> new").select(F.upper("old").alias("old"), F.upper("new").alias("new"), F.col("effective").alias("at")).distinct()
    return materialised(real.withColumn("id", F.concat_ws("|", "old", "new", F.col("at").cast("string"))), "changes")


def _walked(asked: DataFrame, changes: DataFrame, known_on: str, as_of: Column | None) -> tuple[DataFrame, DataFrame]:
    """asked with the symbol in capitals (_s) and its paths from known_on: _back and _on, null where no change leads there; and the changes."""
    c = _known(changes, as_of)
    rows = asked.withColumn("_s", F.upper("symbol"))
    for back, side, out in ((True, "new", "_back"), (False, "old", "_on")):
        firsts = c.join(_paths(c, back), "id").select(F.col(side).alias("_s"), F.col("at").alias("_at"), F.col("path").alias(out))
        rows = asof_join(rows, firsts, by=["_s"], left_ts=known_on, right_ts="_at", take=[out], direction="backward" if back else "forward", allow_equal=back).drop("_at_matched")
    return rows, c


def symbol_on(asked: DataFrame, changes: DataFrame, *, known_on: str, target: str, as_of: Column | None = None, out: str = "symbol_then") -> DataFrame:
    """The symbol on the target day of the listing that was ``symbol`` on the day known_on, by the changes known as_of.

    changes: old, new, effective (the first day under the new one) and, for as_of, available_at. Self-changes say nothing.
    """
    rows, _ = _walked(asked, changes, known_on, as_of)
    before = F.filter("_back", lambda c: c["at"] > F.col(target))
    after = F.filter("_on", lambda c: c["at"] <= F.col(target))
    found = F.when(F.col(target) < F.col(known_on), F.get(before, F.size(before) - 1)["old"]).otherwise(F.get(after, F.size(after) - 1)["new"])
    return rows.select(*asked.columns, F.coalesce(found, "_s").alias(out))


def symbol_windows(asked: DataFrame, changes: DataFrame, *, known_on: str, as_of: Column | None = None) -> DataFrame:
    """A row for each symbol of the listing that was ``symbol`` on the day known_on: name, valid_from (null: since before any known change), valid_to (exclusive; null: still).

    A symbol that an earlier holder had left before starts when that one left it.
    """
    rows, c = _walked(asked, changes, known_on, as_of)
    empty = F.slice(F.array(F.struct(F.lit(None).cast("date").alias("at"), F.lit("").alias("old"), F.lit("").alias("new"))), 1, 0)
    back, on = F.coalesce("_back", empty), F.coalesce("_on", empty)
    oldest = F.get(back, F.size(back) - 1)
    rows = rows.withColumn("_first", F.coalesce(oldest["old"], "_s")).withColumn("_day", F.coalesce(F.date_sub(oldest["at"], 1), F.col(known_on)))
    left = c.select(F.col("old").alias("_first"), F.col("at").alias("_left_at"))
    rows = asof_join(rows, left.withColumn("_l", F.col("_left_at")), by=["_first"], left_ts="_day", right_ts="_left_at", take=["_l"])
    piece = lambda name, start: F.struct(name.alias("name"), start.alias("valid_from"))
    chain = F.concat(F.array(piece(F.col("_first"), F.col("_l"))), F.transform(F.reverse(back), lambda x: piece(x["new"], x["at"])), F.transform(on, lambda x: piece(x["new"], x["at"])))
    rows = rows.withColumn("_chain", chain)
    spans = F.transform("_chain", lambda x, i: F.struct(x["name"].alias("name"), x["valid_from"].alias("valid_from"), F.get(F.col("_chain"), i + 1)["valid_from"].alias("valid_to")))
    return rows.select(*asked.columns, F.explode(spans).alias("w")).select(*asked.columns, "w.*")
