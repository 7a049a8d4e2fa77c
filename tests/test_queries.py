"""Every query of the catalogue against its SQL counterpart, and the driver's entry."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows_of, rows_of_sql
from pyspark.sql import functions as F

from epochlens.operators import windows
from epochlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    found = catalog.queries()[name](spark, SMALL)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name == "stratified_draw"  # its draw is by Spark's own hash; see test_stratified_draw
    else:
        assert rows_of(found) == rows_of_sql(sql, SMALL)


def test_stratified_draw(spark):
    """As many of each stratum as are allocated to it, without repeats, and the same ones each time."""
    drawn = catalog.queries()["stratified_draw"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = {r["lang"]: r["draws"] for r in windows.allocate(docs, "lang", 100).collect()}
    assert {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.countDistinct("doc_id").alias("n")).collect()} == {k: v for k, v in wanted.items() if v} and sum(wanted.values()) == 100
    ids = [sorted(r["doc_id"] for r in catalog.queries()["stratified_draw"](spark, SMALL).collect()) for _ in range(2)]
    assert ids[0] == ids[1]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
