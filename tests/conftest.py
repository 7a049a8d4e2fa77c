"""Session and comparisons that the tests share."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


def rows_of_sql(sql: str, folder: str) -> list[str]:
    with duckdb.connect() as db:
        for t in TABLES:
            if os.path.exists(f"{folder}/{t}.parquet"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        return sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
