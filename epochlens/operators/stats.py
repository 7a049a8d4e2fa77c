"""Statistics: clustered means, multiple testing, bootstraps, Sharpe ratios."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.session import materialised


def student_tail(t: float, df: float) -> float:
    """P(T > t) for a whole or an infinite number of degrees of freedom.

    The chance of lying within t is a finite sum over powers of the cosine of atan(t / sqrt(df)); for infinite degrees it is the normal law's.
    """
    if math.isnan(t) or math.isnan(df) or df < 1:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if math.isinf(df):
        return math.erfc(t / math.sqrt(2)) / 2
    if df != int(df):
        raise ValueError("whole degrees of freedom are handled")
    n, angle = int(df), math.atan2(abs(t), math.sqrt(df))
    cosine = math.cos(angle)
    term = total = cosine if n % 2 else 1.0
    for k in range(3 if n % 2 else 2, n - 1, 2):
        term *= cosine * cosine * (k - 1) / k
        total += term
    within = math.sin(angle) * total
    if n % 2:
        within = 2 / math.pi * (angle + (within if n > 1 else 0.0))
    upper = (1 - within) / 2
    return upper if t >= 0 else 1 - upper


def t_tail(t: Column, df: Column) -> Column:
    """student_tail as a column; for the few rows of a result table."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_tail(float(a), float(b)) if a == a and b == b else float("nan") for a, b in zip(t, df, strict=True)])

    return tail(t, df)


def clustered_mean(rows: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """n, clusters, mean, hit_rate, se (CR1) and t of each group's mean: two aggregations, first within clusters and then over them."""
    live = rows.where(F.col(value).isNotNull())
    inner = live.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum((F.col(value) > 0).cast("long")).alias("hits"))
    # the sum of (s - n m) ** 2 over clusters, from sums alone
    outer = inner.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.sum("s").alias("_s"), F.sum("hits").alias("_hits"), F.sum(F.col("s") * F.col("s")).alias("_ss"), F.sum(F.col("s") * F.col("n")).alias("_sn"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_nn"))
    mean = F.col("_s") / F.col("n")
    spread = F.greatest(F.col("_ss") - 2 * mean * F.col("_sn") + mean * mean * F.col("_nn"), F.lit(0.0))
    se = F.when(F.col("clusters") > 1, F.sqrt(F.try_divide(F.col("clusters"), F.col("clusters") - 1) * spread) / F.col("n"))
    return outer.select(*by, "n", "clusters", mean.alias("mean"), (F.col("_hits") / F.col("n")).alias("hit_rate"), se.alias("se"), (mean / F.nullif(se, F.lit(0.0))).alias("t"))


def bh_adjust(rows: DataFrame, family: list[str], p: str, order: list[str], out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: the running minimum, from the largest p on, of p m / rank; null and NaN are not counted and stay null.

    A family of any size is cut into ranges of p: ranks and minima are made within each and carried over from range to range, of which there are as many as the shuffle has partitions.
    """
    real = F.col(p).isNotNull() & ~F.isnan(p)
    live = materialised(rows.where(real).repartitionByRange(*family, p, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    cut = [*family, "_part"]
    whole = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))  # ranges

    def told(left: DataFrame, ranges: DataFrame) -> DataFrame:
        right = ranges.withColumnsRenamed({c: f"_r_{c}" for c in cut})
        on = F.lit(True)
        for c in cut:
            on &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return left.join(right, on).drop(*(f"_r_{c}" for c in cut))

    sizes = live.groupBy(*cut).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*cut, before.alias("_before"), F.sum("_n").over(whole).alias("_m"))
    ranked = told(live, sizes).withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy(*cut).orderBy(p, *order)))
    ranked = ranked.withColumn("_value", F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rank")))
    later = F.min("_value").over(whole.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1))
    later = ranked.groupBy(*cut).agg(F.min("_value").alias("_value")).select(*cut, later.alias("_later"))
    # from the end of a range, so that each row looks at one more only
    lowest = F.min("_value").over(W.partitionBy(*cut).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0))
    found = told(ranked.withColumn("_own", lowest), later).withColumn(out, F.least("_own", "_later"))
    return found.select(*rows.columns, out).unionByName(rows.where(~real).withColumn(out, F.lit(None).cast("double")))


#: A prime below 2 ** 31, so that squares fit into a long.
PRIME = 2147483647


def scrambled(seed: int, *numbers: Column) -> Column:
    """A whole number below PRIME that looks random, from whole numbers; two squarings, so that it isn't linear in any of them."""
    u = F.lit(seed).cast("long")
    for n in numbers:
        u = (u * 48271 + n.cast("long") * 104729 + 7919) % PRIME
        u = (u * u + 12345) % PRIME
    return (u * u + 69621) % PRIME


#: Draws of a bootstrap that one task makes together.
DRAWS = 100


def bootstrap_means(rows: DataFrame, by: list[str], cluster: str, value: str, resamples: int, seed: int) -> DataFrame:
    """Means of ``resamples`` draws of a group's clusters: by, draw, mean. A draw takes as many clusters as the group has, with replacement.

    The clusters of a group, and the groups, are numbered in order; which cluster the j-th pick of a draw takes is scrambled from the seed, the group, the
    draw and j, so that groups don't share their draws and any run gives the same.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    number = W.partitionBy(*by)
    sums = sums.withColumn("_i", F.row_number().over(number.orderBy(cluster)) - 1)  # dates of a group
    groups = sums.groupBy(*by).agg(F.count("*").alias("_size")).withColumn("_g", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by)))  # a row for each group of a report
    # a group's draws are made by as many tasks as it has blocks of them
    blocks = groups.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // DRAWS)))).repartition(*by, "_b")
    drawn = blocks.withColumn("draw", F.explode(F.sequence(F.col("_b") * DRAWS + 1, F.least((F.col("_b") + 1) * DRAWS, F.lit(resamples)))))
    picks = drawn.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    picks = picks.withColumn("_i", (scrambled(seed, F.col("_g"), F.col("draw"), F.col("_j")) % F.col("_size")).cast("int"))
    found = picks.join(sums, [*by, "_i"]).groupBy(*by, "draw").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    return found.select(*by, "draw", (F.col("_s") / F.col("_n")).alias("mean"))


def bootstrap_interval(rows: DataFrame, by: list[str], cluster: str, value: str, resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    means = bootstrap_means(rows, by, cluster, value, resamples, seed)
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def fcr_bounds(cells: DataFrame, means: DataFrame, by: list[str], family: list[str], q: float) -> DataFrame:
    """cells (by, p_adjusted) with fcr_lower: each one's lower bound at the false-coverage level max(R, 1) q / m, R and m being how many of its family
    are selected and how many have a p-value. means: by, draw, mean."""
    w = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))  # cells of a report
    level = F.greatest(F.count_if(F.col("p_adjusted") <= q).over(w), F.lit(1)) * q / F.greatest(F.count("p_adjusted").over(w), F.lit(1))
    levelled = cells.withColumn("_level", F.least(level, F.lit(1.0)))
    # linear interpolation between the two draws around the level
    v = W.partitionBy(*by)
    ranked = means.withColumn("_k", F.row_number().over(v.orderBy("mean", "draw")) - 1).withColumn("_n", F.count(F.lit(1)).over(v))
    at = F.col("_level") * (F.col("_n") - 1)
    near = ranked.join(levelled.select(*by, "_level"), by).where((F.col("_k") == F.floor(at)) | (F.col("_k") == F.ceil(at)))
    bound = near.groupBy(*by).agg((F.min("mean") + (F.max("mean") - F.min("mean")) * (F.first(at) - F.floor(F.first(at)))).alias("fcr_lower"))
    return levelled.drop("_level").join(bound, by, "left")


def report_cells(rows: DataFrame, by: list[str], family: list[str], cluster: str, value: str, *, resamples: int, seed: int, q: float) -> DataFrame:
    """Cells of a report: the clustered mean, its one-sided p and that adjusted within its family, the bootstrap interval and the false-coverage bound."""
    means = bootstrap_means(rows, by, cluster, value, resamples, seed)
    interval = means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    cells = clustered_mean(rows, by, cluster, value)
    cells = cells.withColumn("p", t_tail(F.col("t"), F.col("clusters").cast("double") - 1)).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    return fcr_bounds(bh_adjust(cells, family, "p", by), means, by, family, q).join(interval, by, "left")


def gate(cells: DataFrame, least_n: int, q: float) -> DataFrame:
    """passed, and the reasons against: too few, mean not positive, not selected, bound not positive. cells: n, mean, p_adjusted, fcr_lower."""
    reasons = F.array_compact(F.array(F.when(F.col("n") < least_n, "n"), F.when(~F.coalesce(F.col("mean") > 0, F.lit(False)), "mean"), F.when(~F.coalesce(F.col("p_adjusted") <= q, F.lit(False)), "selection"), F.when(~F.coalesce(F.col("fcr_lower") > 0, F.lit(False)), "bound")))
    return cells.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.size(reasons) == 0)


def sharpe(rows: DataFrame, by: list[str], ret: str, periods: float = 252.0) -> DataFrame:
    """Sharpe and Sortino ratios, a year; downside deviation over all periods."""
    down = F.sqrt(F.avg(F.pow(F.least(F.col(ret), F.lit(0.0)), 2)))
    return rows.where(F.col(ret).isNotNull()).groupBy(*by).agg((F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0)) * math.sqrt(periods)).alias("sharpe"), (F.avg(ret) / F.nullif(down, F.lit(0.0)) * math.sqrt(periods)).alias("sortino"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Of so many independent trials without skill."""
    if trials < 2:
        return 0.0
    z, euler = NormalDist().inv_cdf, 0.5772156649015329
    return math.sqrt(variance) * ((1 - euler) * z(1 - 1 / trials) + euler * z(1 - 1 / (trials * math.e)))


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true ratio is over the benchmark; kurtosis is 3 for a normal distribution; ratios per period."""
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if n > 1 and spread > 0 else math.nan


def deflated_sharpe(returns: DataFrame, ret: str, trials: int, variance: float) -> float:
    m = returns.where(F.col(ret).isNotNull()).agg(F.count(ret), F.avg(ret), F.stddev_samp(ret), F.skewness(ret), F.kurtosis(ret)).first()
    if not m[0] or not m[2]:
        return math.nan
    return probabilistic_sharpe(m[1] / m[2], expected_max_sharpe(trials, variance), m[0], m[3], m[4] + 3)


def recent_expectancy(trades: DataFrame, by: list[str], order: list[str], net: str, last: int) -> DataFrame:
    """Of each key's last so many closed trades: trades, expectancy (mean net) and lowest running total; what a rule that stops a strategy looks at. Fewer trades than that have no expectancy yet."""
    w = W.partitionBy(*by)
    tail = trades.where(F.col(net).isNotNull()).withColumn("_back", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order)))).where(F.col("_back") <= last)
    total = tail.withColumn("_total", F.sum(net).over(w.orderBy(F.col("_back").desc()).rowsBetween(W.unboundedPreceding, 0)))
    return total.groupBy(*by).agg(F.count("*").alias("trades"), F.when(F.count("*") >= last, F.avg(net)).alias("expectancy"), F.min("_total").alias("lowest"))


def losing_beyond_chance(nets: np.ndarray, confidence: float = 0.95) -> bool:
    """The mean's t interval is wholly below zero."""
    if len(nets) < 2 or not np.std(nets, ddof=1):
        return False
    t = float(np.mean(nets) / (np.std(nets, ddof=1) / math.sqrt(len(nets))))
    return t < 0 and student_tail(-t, len(nets) - 1) < (1 - confidence) / 2
