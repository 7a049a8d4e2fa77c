"""Window operators: rolling medians in three frames, cooldowns, cumulative products, drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rolling_median_rows(rows: DataFrame, by: list[str], order: list[str], value: str, n: int, out: str = "median") -> DataFrame:
    """Median of the n recorded rows strictly before each; null with fewer."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    return rows.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= n, F.percentile(F.col(value), F.lit(0.5)).over(w)))


def rolling_median_sessions(rows: DataFrame, sessions: DataFrame, by: list[str], day: str, value: str, n: int, out: str = "median") -> DataFrame:
    """Median over the n regular sessions before each session, a key's missing days counting as zero; sessions: day, session_no."""
    keys = rows.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    dense = keys.join(F.broadcast(sessions.select(F.col("day").alias(day), "session_no")), F.col(day).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # some thousands of days
    filled = dense.join(rows.select(*by, day, value), [*by, day], "left")
    w = W.partitionBy(*by).orderBy("session_no").rowsBetween(-n, -1)
    return filled.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= n, F.percentile(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.5)).over(w)))


def cooldown(rows: DataFrame, by: list[str], order: list[str], place: str, k: int, out: str = "kept") -> DataFrame:
    """Drops a row that is within k places of the last one kept of its key: a fold over the key's places in order, as a lag can't tell.

    Only the distinct places of a key (days, of which there are some thousands, however many rows it has) are folded together; of a place that is
    kept its first row by order stays, order putting no two rows level.
    """
    first = rows.groupBy(*by, place).agg(F.min(F.struct(*order)).alias("_first"))
    places = first.groupBy(*by).agg(F.sort_array(F.collect_list(place)).alias("_places"))
    none = F.slice("_places", 1, 0)
    kept = F.aggregate("_places", none, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x - F.element_at(acc, -1) > k, F.concat(acc, F.array(x))).otherwise(acc))
    marks = places.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.explode(kept).alias("_place"))
    on = F.col(place) == F.col("_place")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    marked = first.join(marks, on, "left_semi").select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(place).alias("_place"), "_first")
    found = rows.join(marked, on & F.struct(*order).eqNullSafe(F.col("_first")), "left")
    return found.select(*rows.columns, F.col("_first").isNotNull().alias(out))


def _asked(rows: DataFrame, events: DataFrame, key: str, start: str, end: str, inside: Column, value: Column, out: str) -> DataFrame:
    """rows with ``out``, the value over the events (_k, _d, …) inside each row's range; each distinct range is asked for once, so that repeated rows stay as they are."""
    asked = rows.select(F.col(key).alias("_key"), F.col(start).alias("_a"), F.col(end).alias("_b")).distinct()
    found = asked.join(events, (F.col("_key") == F.col("_k")) & inside).groupBy("_key", "_a", "_b").agg(value.alias(out))
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col(start) == F.col("_a")) & (F.col(end) == F.col("_b")), "left").drop("_key", "_a", "_b")


def product_between(rows: DataFrame, factors: DataFrame, key: str, start: str, end: str, day: str, factor: str, out: str = "multiplier") -> DataFrame:
    """Product of a key's factors with day in (start, end]; 1 without any."""
    f = factors.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(factor).alias("_f"))
    found = _asked(rows, f, key, start, end, (F.col("_d") > F.col("_a")) & (F.col("_d") <= F.col("_b")), F.product("_f"), out)
    return found.withColumn(out, F.coalesce(out, F.lit(1.0)))


def any_between(rows: DataFrame, flags: DataFrame, key: str, start: str, end: str, day: str, out: str = "flagged") -> DataFrame:
    """Whether a key has a flagged day in [start, end]."""
    f = flags.select(F.col(key).alias("_k"), F.col(day).alias("_d")).distinct()
    found = _asked(rows, f, key, start, end, F.col("_d").between(F.col("_a"), F.col("_b")), F.lit(True), out)
    return found.withColumn(out, F.coalesce(out, F.lit(False)))


def running_max_before(rows: DataFrame, by: list[str], order: list[str], value: str, out: str = "high_so_far") -> DataFrame:
    return rows.withColumn(out, F.max(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))


def drawdown(rows: DataFrame, by: list[str], order: list[str], equity: str) -> DataFrame:
    """Per key the largest fall from a running peak, in money and as a share of the peak."""
    peak = F.max(equity).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    fallen = rows.withColumn("_peak", peak)
    return fallen.groupBy(*by).agg(F.max(F.col("_peak") - F.col(equity)).alias("max_drawdown"), F.max((F.col("_peak") - F.col(equity)) / F.nullif(F.col("_peak"), F.lit(0))).alias("max_drawdown_share"))


def daily_returns(equity: DataFrame, sessions: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Return of each session on the one before; idle sessions carry the last equity forward."""
    keys = equity.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    dense = keys.join(F.broadcast(sessions.select(F.col("day").alias(day))), F.col(day).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # some thousands of days
    w = W.partitionBy(*by).orderBy(day)
    filled = dense.join(equity.select(*by, day, value), [*by, day], "left").withColumn("_v", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return filled.withColumn("ret", F.try_divide(F.col("_v"), F.lag("_v").over(w)) - 1).select(*by, day, F.col("_v").alias(value), "ret")


def spaced_sample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Every (n // k)-th row of a key, from the first on."""
    w = W.partitionBy(*by)
    numbered = rows.withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / k)))
    return numbered.where((F.col("_n") % F.col("_step") == 0) & (F.col("_n") / F.col("_step") < k)).drop("_n", "_step")


def walk_forward(sessions: DataFrame, train: int, test: int, embargo: int = 0, expanding: bool = False) -> DataFrame:
    """Splits over numbered sessions (session_no from 1): split, train_from, train_to, test_from, test_to."""
    n = sessions.agg(F.max("session_no").alias("n"))
    first = F.when(F.col("n") >= train + embargo + test, F.sequence(F.lit(train + embargo + 1), F.col("n") - test + 1, F.lit(test)))
    splits = n.select(F.posexplode(first).alias("split", "test_from"))
    return splits.select("split", (F.lit(1) if expanding else F.col("test_from") - embargo - train).cast("int").alias("train_from"), (F.col("test_from") - embargo - 1).cast("int").alias("train_to"), F.col("test_from").cast("int"), (F.col("test_from") + test - 1).cast("int").alias("test_to"))


def allocate(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """Largest-remainder allocation of n draws in proportion to the strata's sizes; ties go to the stratum first in order."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("_total"))
    shares = sizes.crossJoin(F.broadcast(total)).withColumn("_q", F.lit(n) * F.col("size") / F.col("_total")).withColumn("_base", F.floor("_q"))  # one row
    w = W.partitionBy(F.lit(0))  # a row for each stratum
    left = F.lit(n) - F.sum("_base").over(w)
    rank = F.row_number().over(w.orderBy((F.col("_q") - F.col("_base")).desc(), F.col(stratum)))
    return shares.withColumn("_left", left).withColumn("_rank", rank).select(stratum, "size", (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("draws"))


def stratified_draw(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The allocated number of rows of each stratum, those with the smallest hashes of their key."""
    sizes = F.broadcast(allocate(rows, stratum, n).select(F.col(stratum).alias("_s"), "draws"))  # a row for each stratum
    drawn = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return drawn.withColumn("_rank", rank).where("_rank <= draws").drop("_rank", "draws")


def cover_sample(rows: DataFrame, order: list[str], n: int, cover: list[str]) -> DataFrame:
    """The first n rows and, for every value of the covered columns, its first row; distinct."""
    head = rows.orderBy(*order).limit(n)
    firsts = [rows.groupBy(c).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*") for c in cover]
    for f in firsts:
        head = head.unionByName(f)
    return head.distinct()
