"""Connected components of an edge table, by alternating large-star and small-star steps.

A node's smallest neighbour comes from an aggregation and is joined back on, so that no node's neighbours are gathered in one place.
A round is some eight shuffles. Up to ``FEW`` edges, a bound that doesn't follow the input, are linked in a single task instead, without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.session import materialised

#: Edges that one task links by itself, some 20 MB.
FEW = 1 << 16


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is linked to the node's smallest neighbour (or itself); small: every smaller one and the node."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = ways.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _linked(edges: DataFrame) -> DataFrame:
    """The roots of FEW edges at most, by union-find."""
    kind = edges.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        of = None
        for batch in batches:
            of = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                root[max(x, y)] = min(x, y)
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), of), pa.array([find(x) for x in root], of)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def components(edges: DataFrame, *, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """edges (a, b), any comparable type, to (node, root): every node that has an edge, and the smallest one it can reach.

    Ends when a round changes nothing; each round is written under the shared folder, so that lineages stay short. Whole numbers, strings and binaries of ``few`` edges at most
    need no rounds.
    """
    now = materialised(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    plain = isinstance(now.schema["a"].dataType, (T.IntegralType, T.StringType, T.BinaryType))
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            # stars: every edge leads from a node to its component's smallest one
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        if seen is None and plain and mark["n"] <= few:
            return materialised(_linked(now), "roots")
        seen = mark
        now = materialised(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError("components did not settle")
