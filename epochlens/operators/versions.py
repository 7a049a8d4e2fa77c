"""Versions of reference data out of all its snapshots, in whatever order these came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.session import materialised


def _runs(rows: DataFrame, whole: DataFrame, owner: list[str], keys: list[str], attrs: list[str], as_of: str) -> DataFrame:
    """Versions of each key from the days on which it was listed: a run of equal attributes goes on until they change or a whole snapshot lacks the key.

    rows: owner, as_of, keys, attrs. whole: owner, as_of, next_whole (the first later snapshot that is not cut short).
    """
    line = W.partitionBy(*owner, *keys).orderBy(as_of)
    seen = rows.join(whole, [*owner, as_of], "left").withColumn("_later", F.lead(as_of).over(line))
    gone = F.when(F.col("next_whole") < F.coalesce("_later", F.lit("9999-12-31").cast("date")), F.col("next_whole"))
    seen = seen.withColumn("_gone", gone).withColumn("_a", F.struct(*attrs))
    starts = F.lag("_a").over(line).isNull() | F.lag("_gone").over(line).isNotNull() | ~F.lag("_a").over(line).eqNullSafe(F.col("_a"))
    marked = seen.withColumn("_run", F.sum(starts.cast("int")).over(line))
    runs = marked.groupBy(*owner, *keys, "_run").agg(F.min(as_of).alias("valid_from"), F.max_by(F.struct("_gone", "_later"), as_of).alias("_end"), F.first("_a").alias("_a"))
    return runs.select(*owner, *keys, "_a.*", "valid_from", F.coalesce("_end._gone", "_end._later").alias("valid_to"))


def rebuild(rows: DataFrame, taken: DataFrame, *, owner: list[str], keys: list[str], attrs: list[str], as_of: str = "as_of", least_share: float = 0.95) -> DataFrame:
    """Versions [valid_from, valid_to) as if all snapshots had been applied in the order of their days, whenever they came.

    rows: owner columns (the list that a snapshot is one of; it closes its own keys only), as_of, keys, attrs. taken: owner, as_of of every snapshot, also of empty ones. Of a key's repeated rows in
    one snapshot the least counts. A snapshot that has less than least_share of the keys open before it closes none (an empty one never does). Whether it has depends on what earlier ones closed, so that
    they are judged over again until no judgement changes; each pass settles the next one that is cut short at least. Judgements are a row for each snapshot.
    """
    listed = rows.groupBy(*owner, as_of, *keys).agg(F.min(F.struct(*attrs)).alias("_r")).select(*owner, as_of, *keys, "_r.*")
    listed = materialised(listed, "snapshots")
    sizes = materialised(taken.select(*owner, as_of).distinct().join(listed.groupBy(*owner, as_of).agg(F.count("*").alias("_n")), [*owner, as_of], "left").select(*owner, as_of, F.coalesce("_n", F.lit(0)).alias("_n")), "sizes")
    after = W.partitionBy(*owner).orderBy(as_of).rowsBetween(1, W.unboundedFollowing)
    before = W.partitionBy(*owner).orderBy(as_of).rowsBetween(W.unboundedPreceding, -1)
    judged = sizes.withColumn("_whole", F.col("_n") > 0)
    while True:
        whole = judged.withColumn("next_whole", F.min(F.when(F.col("_whole"), F.col(as_of))).over(after)).select(*owner, as_of, "next_whole")
        runs = materialised(_runs(listed, whole, owner, keys, attrs, as_of), "versions")
        moves = runs.select(*owner, F.col("valid_from").alias(as_of), F.lit(1).alias("_d")).unionByName(runs.where("valid_to is not null").select(*owner, F.col("valid_to").alias(as_of), F.lit(-1).alias("_d")))
        change = moves.groupBy(*owner, as_of).agg(F.sum("_d").alias("_d"))
        opened = judged.join(change, [*owner, as_of], "left").withColumn("_open", F.coalesce(F.sum("_d").over(before), F.lit(0)))
        now = opened.withColumn("_now", (F.col("_n") > 0) & (F.col("_n") >= least_share * F.col("_open")))
        now = materialised(now.select(*owner, as_of, "_n", "_whole", "_now"), "judged")
        if not now.where("_whole <> _now").limit(1).count():
            return runs
        # a judgement that follows another changed one of its list may change again: only the first one is taken over, the rest is judged anew
        first = now.where("_whole <> _now").groupBy(*owner).agg(F.min(as_of).alias("_first"))
        judged = now.join(first, owner, "left").select(*owner, as_of, "_n", F.when(F.col(as_of) <= F.col("_first"), F.col("_now")).otherwise(F.col("_whole")).alias("_whole"))
