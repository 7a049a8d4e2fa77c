"""Polls of a source as a Spark data source, for batches and streams.

publish() writes what a poll brings that the store doesn't have yet, and commits it under the poll's number: the offset of a stream is how many polls are committed, so that a stream that is started again goes on where it
was, and a poll that failed half-way is never seen. Each payload's digest is checked in the task that reads it; one that has changed comes as a row with an error and without its content, for quarantine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "polled_store"
SCHEMA = "doc_id string, kind string, fetched_at timestamp, poll long, content binary, error string"
_STORED = "doc_id string, content binary, kind string, fetched_at timestamp"


def _system(folder: str):
    """pyarrow's file system and path: tasks and the planning worker open files without a Spark session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder if ":/" in folder else f"file://{folder}"))


def committed(folder: str) -> int:
    """How many polls are committed: 0, 1, … without a gap."""
    from pyarrow import fs

    system, path = _system(folder)
    found = system.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True))
    return len([x for x in found if x.type == fs.FileType.File and re.fullmatch(r"\d{8}", x.base_name)])


def _commit(rows: DataFrame, folder: str) -> int:
    number = committed(folder)
    rows.write.mode("overwrite").parquet(f"{folder}/polls/{number:08d}")
    system, path = _system(folder)
    system.create_dir(f"{path}/commits", recursive=True)
    with system.open_output_stream(f"{path}/commits/{number:08d}") as out:
        out.write(b"")
    return number


def publish(payloads: DataFrame, folder: str) -> int:
    """A poll's payloads (content, kind, fetched_at), of which the store takes those it doesn't have, each once; gives the poll's number. One source is polled by one writer."""
    spark = payloads.sparkSession
    new = payloads.where("content is not null").withColumn("doc_id", F.sha2("content", 256)).groupBy("doc_id").agg(F.min_by(F.struct("content", "kind", "fetched_at"), F.struct("fetched_at", "kind")).alias("p")).select("doc_id", "p.*")
    before = committed(folder)
    if before:
        known = spark.read.schema(_STORED).parquet(*(f"{folder}/polls/{i:08d}" for i in range(before))).select("doc_id")
        new = new.join(known, "doc_id", "left_anti")
    return _commit(new, folder)


class _File(InputPartition):
    def __init__(self, uri: str, poll: int):
        self.uri, self.poll = uri, poll


def _files(folder: str, start: int, end: int) -> list[_File]:
    from pyarrow import fs

    system, path = _system(folder)
    scheme = folder.split(":/")[0] if ":/" in folder else "file"
    out = []
    for poll in range(start, end):
        for x in system.get_file_info(fs.FileSelector(f"{path}/polls/{poll:08d}")):
            if x.base_name.endswith(".parquet"):
                out.append(_File(x.path if scheme == "file" else f"{scheme}://{x.path}", poll))
    return out


def _rows(part: _File) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, path = _system(part.uri)
    with system.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=256, columns=["doc_id", "content", "kind", "fetched_at"]):
            ids, contents = batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()
            sound = [hashlib.sha256(c).hexdigest() == i for i, c in zip(ids, contents, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("kind"), batch.column("fetched_at").cast(pa.timestamp("us", "UTC")), pa.array([part.poll] * len(ids), pa.int64()),
                pa.array([c if s else None for c, s in zip(contents, sound, strict=True)], pa.binary()), pa.array([None if s else "digest" for s in sound], pa.string()),
            ], names=["doc_id", "kind", "fetched_at", "poll", "content", "error"])


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return _files(self.folder, 0, committed(self.folder)) or [_File("", -1)]

    def read(self, partition):
        if partition.poll >= 0:
            yield from _rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        return {"polls": committed(self.folder)}

    def partitions(self, start: dict, end: dict):
        return _files(self.folder, start["polls"], end["polls"])

    def read(self, partition):
        yield from _rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is thrown away: the store keeps all payloads."""


class PolledStore(DataSource):
    """spark.read.format("polled_store").load(folder), and the same with readStream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PolledStore)


def sound_and_damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads, and what goes to quarantine."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").drop("content")
