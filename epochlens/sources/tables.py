"""Stored tables with a schema version of their own: older ones are brought up as they are read, newer ones are refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_schema_version"


@dataclass(frozen=True)
class Table:
    """columns: those of version 1 with their types. steps: for each further version the columns that it adds, with type and default as SQL. Steps only add; a column's type never changes."""

    name: str
    columns: dict[str, str]
    steps: list[dict[str, tuple[str, str]]] = field(default_factory=list)

    @property
    def version(self) -> int:
        return 1 + len(self.steps)

    def ddl(self, version: int | None = None) -> str:
        added = {c: kind for step in self.steps[: (version or self.version) - 1] for c, (kind, _) in step.items()}
        return ", ".join(f"`{c}` {kind}" for c, kind in {**self.columns, **added}.items())


def save(rows: DataFrame, folder: str, table: Table, *, mode: str = "append") -> None:
    """Rows with the table's present columns, each file's rows marked with the version that wrote them."""
    rows.select(*(F.col(f"`{c}`") for c in _names(table))).withColumn(VERSION, F.lit(table.version)).write.mode(mode).partitionBy(VERSION).parquet(folder)


def _names(table: Table) -> list[str]:
    return [*table.columns, *(c for step in table.steps for c in step)]


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in system.listStatus(p)] if system.exists(p) else []
    return sorted(int(x.split("=")[1]) for x in found if x.startswith(f"{VERSION}="))


def load(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """All rows in the present shape: of rows that an older version wrote the added columns have their defaults (which may speak of older columns). A folder with rows of a newer version raises."""
    versions = stored_versions(spark, folder)
    if versions and versions[-1] > table.version:
        raise ValueError(f"{table.name} holds rows of schema version {versions[-1]}; this code knows {table.version}")
    out = spark.createDataFrame([], table.ddl())
    for version in versions:
        rows = spark.read.schema(table.ddl(version)).parquet(f"{folder}/{VERSION}={version}")
        for step in table.steps[version - 1 :]:
            rows = rows.withColumns({c: F.expr(default).cast(kind) for c, (kind, default) in step.items()})
        out = out.unionByName(rows.select(*(F.col(f"`{c}`") for c in _names(table))))
    return out
