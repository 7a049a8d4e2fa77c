"""Mutations as table-to-table functions: insert-or-ignore, upsert, slowly changing dimensions, bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*batch.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch with new keys are added; the first write of a key wins."""
    return target.unionByName(keep_first(batch, keys, order).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Known keys get the batch's values of the updated columns only, so that first-seen columns survive; batch has one row a key."""
    t, b = target.withColumn("_t", F.lit(True)), batch.withColumn("_b", F.lit(True))
    joined = t.alias("t").join(b.alias("b"), keys, "full_outer")
    value = lambda c: F.when(F.col("_b") & (F.col("_t").isNull() | F.lit(c in update)), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return joined.select(*keys, *(value(c) for c in target.columns if c not in keys)).select(*target.columns)


def reparse(target: DataFrame, parsed: DataFrame, keys: list[str], lineage: str, update: list[str], frozen: list[str]) -> DataFrame:
    """Parsed columns are refreshed where they come from the same payload; frozen (ingest) columns never change; dropped rows come back."""
    both = target.alias("t").join(parsed.alias("p").withColumn("_p", F.lit(True)), keys, "left")
    same = F.coalesce(F.col("_p") & (F.col(f"t.{lineage}") == F.col(f"p.{lineage}")), F.lit(False))
    kept = both.select(*keys, *((F.when(same, F.col(f"p.{c}")).otherwise(F.col(f"t.{c}")) if c in update and c not in frozen else F.col(f"t.{c}")).alias(c) for c in target.columns if c not in keys))
    return kept.select(*target.columns).unionByName(parsed.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def scd2_apply(versions: DataFrame, snapshot: DataFrame, *, keys: list[str], attrs: list[str], as_of: Column, least_share: float = 0.95, scope: Column | None = None) -> DataFrame:
    """A snapshot applied to versions [valid_from, valid_to): unchanged, rewritten the same day, closed and opened, inserted, or closed as missing.

    It may come late: it meets the versions that held on its day, a changed one ends where the met one did, and one that is new then ends where its key's next known one begins.
    scope (a condition on versions): those that the snapshot speaks for; others of the table stay as they are. Missing keys are closed only if the snapshot isn't empty and
    has least_share of the versions that held on its day at least, else it counts as cut short. snapshot has one row a key.
    """
    speaks = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    touched = speaks & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    met = versions.where(touched & (F.col("valid_from") <= as_of))
    rest = versions.where(~(touched & (F.col("valid_from") <= as_of)))
    following = versions.where(touched & (F.col("valid_from") > as_of)).groupBy(*keys).agg(F.min("valid_from").alias("_next"))
    taken = rest.where(F.col("valid_from") == as_of).select(*keys).distinct().withColumn("_taken", F.lit(True))
    sizes = met.agg(F.count("*").alias("_open")).crossJoin(snapshot.agg(F.count("*").alias("_snap")))
    whole = (F.col("_snap") > 0) & (F.col("_snap") >= least_share * F.col("_open"))
    s = snapshot.select(*keys, F.struct(*attrs).alias("_new"), F.lit(True).alias("_s")).join(following, keys, "left").join(taken, keys, "left")
    joined = met.select(*keys, F.struct(*attrs).alias("_old"), "valid_from", "valid_to", F.lit(True).alias("_o")).join(s, keys, "full_outer").crossJoin(F.broadcast(sizes))  # one row
    same = F.col("_old").eqNullSafe(F.col("_new"))
    today = F.col("valid_from") == as_of
    piece = lambda attrs_of, start, end: F.struct(F.col(attrs_of).alias("a"), start.alias("valid_from"), end.cast("date").alias("valid_to"))
    start, end = F.col("valid_from"), F.col("valid_to")
    nothing = F.slice(F.array(piece("_new", as_of, end)), 1, 0)
    out = (
        F.when(F.col("_o").isNull(), F.when(F.col("_taken"), nothing).otherwise(F.array(piece("_new", as_of, F.col("_next")))))
        .when(F.col("_s").isNull(), F.array(piece("_old", start, F.when(whole, as_of).otherwise(end))))
        .when(same, F.array(piece("_old", start, end)))
        .when(today, F.array(piece("_new", as_of, end)))
        .otherwise(F.array(piece("_old", start, as_of), piece("_new", as_of, end)))
    )
    now = joined.select(*keys, F.explode(out).alias("v")).select(*keys, "v.a.*", "v.valid_from", "v.valid_to")
    return rest.select(*now.columns).unionByName(now)


def newer_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of which the new rows win on equal keys; neither side repeats a key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def attempts(log: DataFrame, keys: list[str], at: str, status: str, most: int) -> DataFrame:
    """Bookkeeping of repeated tries: how many, the last status, and what that makes: complete, gave_up or incomplete."""
    found = log.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by(status, at).alias("last_status"), F.bool_or(F.col(status) == "complete").alias("_done"))
    return found.select(*keys, "attempts", "last_status", F.when(F.col("_done"), "complete").when(F.col("attempts") >= most, "gave_up").otherwise("incomplete").alias("status"))


def windows_of_changes(changes: DataFrame, key: list[str], start: str) -> DataFrame:
    """valid_to of each change is the start of the next one of its key."""
    return changes.withColumn("valid_to", F.lead(start).over(W.partitionBy(*key).orderBy(start)))


def pending(source: DataFrame, derived: DataFrame, keys: list[str], version: Column | None = None) -> DataFrame:
    """Rows that have no derived row (of this version) yet."""
    done = derived.where(version) if version is not None else derived
    return source.join(done.select(*keys), keys, "left_anti")


def prefer(rows: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """Rows of the preferred kind, and the others only for keys that have none of it."""
    best = rows.where(preferred)
    return best.unionByName(rows.where(~preferred).join(best.select(*keys).distinct(), keys, "left_anti"))
