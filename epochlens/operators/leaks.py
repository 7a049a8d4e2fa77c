"""Does a query see the future? What comes after a moment is changed, and nothing decided before it may change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.session import materialised

Run = Callable[[dict[str, DataFrame]], DataFrame]


def _changed(c: str, kind: T.DataType, noise: Column) -> Column:
    """Another value of the type, from a non-negative number of the row; null stays null."""
    value = F.col(f"`{c}`")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return (value * (0.5 + F.pmod(noise, F.lit(1000)) / 1000) + 1).cast(kind)
    if isinstance(kind, T.IntegralType):
        return (value + F.pmod(noise, F.lit(97)) + 1).cast(kind)
    if isinstance(kind, T.BooleanType):
        return ~value
    return F.concat(F.lit("~"), value) if isinstance(kind, T.StringType) else value


def perturbed(rows: DataFrame, known: str, cut: Column, *, keep: list[str], seed: int = 0) -> DataFrame:
    """rows of which those known after the cut have other numbers, texts and flags. known and the columns of keep (identifiers, instants) stay as they are, so that the same rows are there at the same times."""
    after = F.col(known) > cut
    noise = F.xxhash64(*(F.col(f"`{c}`") for c in (known, *keep)), F.lit(seed)).bitwiseAND(F.lit(2**62 - 1))
    return rows.select(*(F.col(f"`{f.name}`") if f.name == known or f.name in keep else F.when(after, _changed(f.name, f.dataType, noise)).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields))


def moments(rows: DataFrame, known: str, n: int, seed: int = 0) -> list:
    """n instants at which something became known, drawn by a hash of the instant."""
    drawn = rows.select(F.col(known).alias("at")).where("at is not null").distinct().orderBy(F.xxhash64("at", F.lit(seed)), "at").limit(n)
    return sorted(r["at"] for r in drawn.collect())


def _prints(found: DataFrame, decided: str, cut: Column) -> DataFrame:
    whole = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(found.columns))), {"ignoreNullFields": "false"}))
    return found.where(F.col(decided) <= cut).select(whole.alias("h"), F.col(decided).alias("decided")).groupBy("h").agg(F.count("*").alias("n"), F.min("decided").alias("decided"))


def find_leaks(run: Run, tables: dict[str, DataFrame], known: dict[str, tuple[str, list[str]]], cuts: list, *, decided: str, seed: int = 0) -> DataFrame:
    """cut, rows, first: how many rows decided by each cut differ once what came after it is changed, and the earliest of their decisions; a query without leaks has 0 rows at every cut.

    run makes its result of tables alone; known names for each table that is changed its instant and the columns that stay; decided is the instant in the result at which a row was decided. The comparison is by hashes of whole rows, repeated ones counted.
    """
    spark = next(iter(tables.values())).sparkSession
    before = materialised(run(tables), "unchanged")
    out = None
    for at in cuts:
        cut = F.lit(at).cast("timestamp")
        after = run({n: perturbed(t, known[n][0], cut, keep=known[n][1], seed=seed) if n in known else t for n, t in tables.items()})
        both = _prints(before, decided, cut).alias("b").join(_prints(after, decided, cut).alias("a"), "h", "full_outer")
        lost = F.coalesce("b.n", F.lit(0)) != F.coalesce("a.n", F.lit(0))
        row = both.where(lost).agg(F.count("b.n").alias("rows"), F.min(F.coalesce("b.decided", "a.decided")).alias("first")).select(cut.alias("cut"), "rows", "first")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "cut timestamp, rows long, first timestamp")
