"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges; a task looks in its range for the gzip magic, takes a place
for a member only if inflating from there gives one whole record (version, type, record id, and a length that agrees), goes on behind it, and owns exactly the records that start inside its range, reading past
its end where the last of them does. Ranges are gone through twice: first each tells how far its last record reaches, of which only that number is kept; then each begins where the records before it end. So the records are those that one
scan of the whole file finds, however it is cut: what lies inside a record's data is none, and what is damaged or cut off takes nothing else with it.

The writer's tasks give every file a name of their own attempt, and the manifest that Spark commits lists those of the attempts that
counted, so that a lost executor leaves unlisted files at most.

Defined results: a null payload is an empty one; of equal payloads of at least ``min_revisit_bytes`` the smallest id is the response and
the others revisit it (rows with the same id: each is written, the id is the response for all of them); smaller ones are all responses;
null ids are written with an empty record id and read back as null; an empty table gives no files and no rows; further columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.llm.common import materialised, slices, table, work_path

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this size are not worth a revisit record.
MIN_REVISIT_BYTES = 100
#: Bytes of a range, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Ranges at most that each have a task of their own.
MOST_TASKS = 100_000
#: A digest with over this share of all rows counts as frequent: there are fewer than FREQUENT of them, 40 bytes each.
FREQUENT = 4096
_VERSION = re.compile(r"WARC/[0-9]+\.[0-9]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_bytes(record_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, whose Content-Length is the full payload's, and drops the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Source:
    """Random access to a file by blocks; keeps the block at hand."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(n, READ_BYTES), max(0, self.size - at)), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]


def header_of(content: bytes) -> dict | None:
    """Headers of an inflated member by lower-case name, and its block; None unless it is one whole WARC record."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not _VERSION.fullmatch(lines[0]) or not all(":" in x for x in lines[1:]):
        return None
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = found.get("content-length", "")
    if not {"warc-type", "warc-record-id"} <= found.keys() or not (length.isascii() and length.isdigit()):
        return None
    block, tail = rest[: int(length)], rest[int(length) :]
    return found | {"block": block} if len(block) == int(length) and tail in (b"", b"\r\n", b"\r\n\r\n") else None


def inflate_member(source: _Source, at: int) -> tuple[dict, int] | None:
    """The record in the gzip member at this place, and the member's end; None if there is no member with a whole record."""
    unpack, out, place, lead = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof:
            data = source.read(place, 1 << 16)
            if not data:
                return None
            out.append(unpack.decompress(data))
            place += len(data) - len(unpack.unused_data)
            lead += out[-1][:5] if len(lead) < 5 else b""
            if len(lead) >= 5 and not lead.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    found = header_of(b"".join(out))
    return None if found is None else (found, place)


def records_in(uri: str, start: int, end: int) -> Iterator[tuple[int, dict, int]]:
    """(place, record, its end) of each record that a scan from start meets before end: the next whole record, then the next one behind that."""
    source, at = _Source(uri), start
    while at < min(end, source.size):
        window = source.read(at, min(READ_BYTES, source.size - at))
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        if (found := inflate_member(source, at)) is None:
            at += 1
        else:
            yield at, found[0], found[1]
            at = found[1]


def _begun(ranges: DataFrame, tasks: int) -> DataFrame:
    """ranges (path, start, end) that begin where all records that start before them end; those that lie wholly inside one are left out.

    A range that begins inside a record may take what that holds for records, but these end where it ends at the latest, so that the farthest reach is right.
    """

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, ends = (c.to_pylist() for c in batch.columns)
            reached = [max((e for _, _, e in records_in(*x)), default=0) for x in zip(paths, starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.int64())], ["path", "start", "end", "reach"])

    told = materialised(ranges.repartition(tasks).mapInArrow(reach, "path string, start long, end long, reach long"), "reach")
    before = F.max("reach").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))  # a row for each range of a file
    begun = told.withColumn("start", F.greatest("start", F.coalesce(before, F.lit(0))))
    return begun.where("reach > 0 and start < end").select("path", "start", "end")


def read_warc(files: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (path, size), the same for every split_bytes: path, offset, record_type, record_id, url, refers_to, payload_digest, payload_bytes, payload.

    payload is null in revisits; payload_bytes is then the full payload's, from the HTTP head that they keep.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long"))).alias("start"))
    # so many tasks as there are ranges: a number that is given isn't coalesced, however few bytes the ranges themselves have
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(1))).first()[0]
    tasks = max(1, min(int(tasks), MOST_TASKS))
    ranges = _begun(ranges.select("path", "start", (F.col("start") + split_bytes).alias("end")), tasks).repartition(tasks)

    def row(path: str, at: int, r: dict) -> tuple:
        http, _, payload = r["block"].partition(b"\r\n\r\n")
        lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if re.fullmatch(rb"(?i)content-length:\s*[0-9]+\s*", x)]
        revisit = r.get("warc-type") == "revisit"
        bare = lambda x: x and x.strip("<>")
        digest = r.get("warc-payload-digest", "").removeprefix("sha256:")
        if not revisit:  # the digest is that of the bytes read, not the one written down
            digest = hashlib.sha256(payload).hexdigest()
        return path, at, r.get("warc-type"), bare(r.get("warc-record-id")), r.get("warc-target-uri"), bare(r.get("warc-refers-to")), digest, lengths[0] if revisit and lengths else len(payload), None if revisit else payload

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["path", "offset", "record_type", "record_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                held = 0
                for at, record, _ in records_in(path, start, end):
                    rows.append(row(path, at, record))
                    held += len(record["block"])
                    if len(rows) == 128 or held > READ_BYTES:
                        yield give(rows)
                        rows, held = [], 0
                if rows:
                    yield give(rows)

    return ranges.mapInArrow(run, "path string, offset long, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def with_first_record(pages: DataFrame, *, min_revisit_bytes: int) -> DataFrame:
    """page, url, payload and refers_to: the smallest id with the row's payload, null for the rows of that id and for small payloads.

    Each row is linked by the digest of its own payload, so that an id may come with several payloads. Only ids and digests are summed
    up. Frequent digests are few and are looked up where the rows are; the rows of the others are joined by digest, and all rows that have
    nothing to look up are spread evenly.
    """
    digest = F.when(F.octet_length("payload") >= min_revisit_bytes, F.unhex(F.sha2(F.encode("payload", "utf-8"), 256)))
    grouped = pages.select("page", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialised(grouped, "first-records")
    bound = pages.count() // FREQUENT
    frequent = first.where(F.col("n") > bound).select("digest", F.col("first").alias("frequent"))
    rare = first.where(F.col("n") <= bound).select(F.col("digest").alias("key"), "first")
    rows = pages.withColumn("digest", digest).join(F.broadcast(frequent), "digest", "left")
    spread = F.encode(F.concat(F.lit("-"), F.xxhash64("page", "url", F.monotonically_increasing_id()).cast("string")), "utf-8")
    rows = rows.withColumn("key", F.when(F.col("digest").isNull() | F.col("frequent").isNotNull(), spread).otherwise(F.col("digest")))
    found = F.coalesce("frequent", "first")
    return rows.join(rare, "key", "left").select("page", "url", "payload", F.when(F.col("page") != found, found).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each row into gzip archives under ``folder`` (a URI that all executors share); gives the manifest: path, size, records."""
    spark = pages.sparkSession
    plain = pages.select(F.col(id_col).alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    linked = with_first_record(plain, min_revisit_bytes=min_revisit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = _open(uri)
        out, records = None, 0
        for batch in batches:
            for part in slices(batch):
                for page, url, payload, refers_to in zip(*(part.column(n).to_pylist() for n in ("page", "url", "payload", "refers_to")), strict=True):
                    if out is None:
                        fs.create_dir(path.rpartition("/")[0])
                        out = fs.open_output_stream(path, compression=None)
                    out.write(record_bytes("" if page is None else str(page), url.replace("\r", "%0D").replace("\n", "%0A"), payload.encode(), None if refers_to is None else str(refers_to)))
                    records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "size", "records"])

    manifest = f"{folder}/manifest"
    linked.mapInArrow(run, "path string, size long, records long").write.parquet(manifest)
    return spark.read.schema("path string, size long, records long").parquet(manifest)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = read_warc(write_warc(pages, work_path(spark, "warc")))
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).try_cast(pages.schema["page_id"].dataType)
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "url")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url
FROM f
"""
