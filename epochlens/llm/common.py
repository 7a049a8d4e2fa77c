"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.session import materialised, shared_dir, work_path  # noqa: F401

#: Rows of a batch, and bytes of their strings, that are held decoded at once in a Python worker; a longer row stands alone.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batch in pieces of at most so many rows and bytes of strings (one row at least); a batch without rows gives none."""
    held = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            held[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(held, held[at] + size, "right")) - 1
        until = max(at + 1, min(until, at + rows, batch.num_rows))
        yield batch.slice(at, until - at)
        at = until


def series_slices(series: Iterable) -> Iterator[list[str | None]]:
    """The same of a series of texts, whose other values count as null; nothing is copied as a whole."""
    held: list[str | None] = []
    size = 0
    for x in series:
        x = x if isinstance(x, str) else None
        if held and (len(held) == SLICE_ROWS or size + len(x or "") > SLICE_BYTES):
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x or "")
    if held:
        yield held


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x.encode("utf-8") for x in column.to_pylist()]


def folded_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes methods touch ASCII only)."""
    return text.lower().split()


def doc_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly two columns, id and text: other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string")) % folds
