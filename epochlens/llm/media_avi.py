"""Media columns: AVI motion-JPEG clips.

The RIFF chunk tree and its indexes (idx1, or the OpenDML standard index) give the frames of a binary column; each frame is
decoded as a baseline intra JPEG; frames whose luma histogram differs from the last one's by more than an adaptive bound begin a
new shot, and every shot becomes a timed clip row.

``texts_as_avi`` stores bytes losslessly in such a file. JPEG's units are the quantised coefficients of 8 x 8 blocks, so 64 bytes
make a block: byte b is the coefficient 512 + b, all steps of the quantisation table are 1, and blocks end with restart markers so that
no coefficient depends on another block. All of these coefficients fall in one size class, so that a table with one code of six bits
codes each in exactly 16 bits.

Defined results: null and empty texts are stored as 64 zero bytes; equal texts give equal files and features; null or broken media
give no clip rows, and null features in ``avi_features``; repeated rows give equal rows; an empty table gives no rows; of equal differences the first passes a bound as the
others do, no order being asked for; texts are handled whole, up to the 4 GB that RIFF's sizes can say (1.9 GB of text, about what a row of Spark can hold);
further columns are left behind.

The features of stored texts describe the samples that their coefficients give, many of which lie beyond 8 bits and are clipped: equal texts
have equal features, but shots of stored texts mean nothing more. Those of real clips are what the decoder is for.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from epochlens.llm.common import doc_texts, slices, table, texts

BLOCK = 64
#: Blocks along each side of a stored frame, and frames a second.
SIDE, FPS = 4, 25
#: Luma bins; a cut needs this difference at least, and this many deviations over the mean of the shot's last differences.
BINS, LEAST_CUT, CUT_DEVIATIONS, CUT_HISTORY = 32, 0.15, 3.0, 12

# fixed values: scan order of the 8 x 8 coefficients (by anti-diagonals)
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Coefficients in rows of 64 to samples in rows of 64.
INVERSE = np.kron(_BASIS, _BASIS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_table(kind: int, symbol: int) -> bytes:
    """A Huffman table with one code, six zero bits."""
    return bytes([kind << 4, *(1 if n == 6 else 0 for n in range(1, 17)), symbol])


def _frame_head(blocks_wide: int, blocks_high: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * blocks_high, 8 * blocks_wide, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, _code_table(0, 10) + _code_table(1, 10)),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


HEAD = _frame_head(SIDE, SIDE)


def store_frames(payload: bytes) -> list[bytes]:
    """Baseline JPEG frames that hold the payload, filled up with zero bytes to whole frames."""
    per_frame = BLOCK * SIDE * SIDE
    data = np.frombuffer(payload + bytes(-len(payload) % per_frame), np.uint8).reshape(-1, BLOCK)
    coded = np.full((len(data), 2 * BLOCK), 2, np.uint8)
    coded[:, 1::2] = data
    frames = []
    full = (data == 0xFF).any()
    for at in range(0, len(data), SIDE * SIDE):
        marks = np.full((SIDE * SIDE, 2), 0xFF, np.uint8)
        marks[:, 1] = 0xD0 + np.arange(SIDE * SIDE) % 8
        rows = coded[at : at + SIDE * SIDE]
        if full:  # a byte FF in the code is followed by 00
            scan = b"".join(r.tobytes().replace(b"\xff", b"\xff\0") + m.tobytes() for r, m in zip(rows, marks, strict=True))
        else:
            scan = np.concatenate([rows, marks], axis=1).tobytes()
        frames.append(HEAD + scan[:-2] + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment + b"\0")) if comment else b""
    body, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of each chunk's body within a range."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> dict:
    """fps, comment and the (start, size) of every video frame, by idx1, else by an OpenDML index, else by the chunks themselves."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"fps": float(FPS), "comment": b"", "frames": []}
    movi, old, standard = (0, 0), [], []
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        for name, start, end in _chunks(data, *stack.pop()):
            if name == b"LIST":
                if data[start : start + 4] == b"movi":
                    movi = (start, end)
                else:
                    stack.append((start + 4, end))
            elif name == b"strh" and data[start : start + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, start + 20)
                found["fps"] = rate / scale if scale and rate else float(FPS)
            elif name == b"ICMT":
                found["comment"] = data[start:end].rstrip(b"\0")
            elif name == b"idx1":
                old = [e for e in struct.iter_unpack("<4sIII", data[start : end - (end - start) % 16]) if e[0][2:] in (b"dc", b"db")]
            elif name[:2] == b"ix" or (name == b"indx" and data[start + 3] == 1):
                standard.append(start)
    for name, start, end in _chunks(data, movi[0] + 4, movi[1]):
        if name[:2] == b"ix":
            standard.append(start)
        elif name[2:] in (b"dc", b"db"):
            found["frames"].append((start, end - start))
    if old:
        base = movi[0] if data[movi[0] + old[0][2] : movi[0] + old[0][2] + 4] == old[0][0] else 0
        found["frames"] = [(base + at + 8, size) for _, _, at, size in old]
    elif standard:
        found["frames"] = []
        for start in standard:
            _, _, _, n, _, base, _ = struct.unpack_from("<HBBI4sQI", data, start)
            found["frames"] += [(base + at, size & 0x7FFFFFFF) for at, size in struct.iter_unpack("<II", data[start + 24 : start + 24 + 8 * n])]
    return found


def parse_jpeg(data: bytes) -> dict:
    """Tables, frame and the entropy-coded bytes of a baseline JPEG."""
    out: dict = {"quant": {}, "codes": {}, "restart": 0}
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["codes"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9", at)
            out["coded"] = data[at : end if end >= 0 else len(data)]
            break
    return out


def _code_lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """(length, symbol) of the code that the next 16 bits begin with."""
    found: list[tuple[int, int] | None] = [None] * (1 << 16)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            width = 1 << (16 - length)
            found[code * width : (code + 1) * width] = [(length, symbols[k])] * width
            code, k = code + 1, k + 1
        code <<= 1
    return found


class _Bits:
    """A reader over entropy-coded bytes; every read touches the bytes around it only."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(4), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the scan ends early")
        return value

    def symbol(self, codes: list[tuple[int, int] | None]) -> int:
        found = codes[self.peek(16)]
        if found is None or self.at + found[0] > self.end:
            raise ValueError("no such code")
        self.at += found[0]
        return found[1]

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def luma_coefficients(jpeg: dict) -> np.ndarray:
    """Quantised coefficients of the first component in scan order: one row of 64 for each block, blocks in raster order of its plane."""
    segments = [s.replace(b"\xff\0", b"\xff") for s in re.split(rb"\xff[\xd0-\xd7]", jpeg["coded"])]
    if len(jpeg["parts"]) == 1 and jpeg["restart"] == 1 and all(jpeg["codes"].get(k) == (bytes([0] * 5 + [1] + [0] * 10), b"\x0a") for k in (0, 16)) and {len(s) for s in segments} == {2 * BLOCK}:
        pairs = np.frombuffer(b"".join(segments), np.uint8).reshape(-1, BLOCK, 2)
        if (pairs[..., 0] == 2).all():  # each coefficient has the one code and ten bits, 512 + b
            return pairs[..., 1].astype(np.int64) + 512
    tables = {k: _code_lookup(*v) for k, v in jpeg["codes"].items()}
    across, down = max(p[1] for p in jpeg["parts"]), max(p[2] for p in jpeg["parts"])
    if len(jpeg["parts"]) == 1:
        across = down = 1
        shape = [(1, 1)]
    else:
        shape = [(h, v) for _, h, v, _ in jpeg["parts"]]
    wide, high = -(-jpeg["width"] // (8 * across)), -(-jpeg["height"] // (8 * down))
    luma = np.zeros((high * shape[0][1], wide * shape[0][0], 64), np.int64)
    unit = 0
    for segment in segments if jpeg["restart"] else [b"".join(segments)]:
        bits, last = _Bits(segment), [0] * len(shape)
        for _ in range(jpeg["restart"] or wide * high):
            if unit == wide * high:
                break
            for c, (h, v) in enumerate(shape):
                tables_of = jpeg["scan"][c][1]
                dc, ac = tables[tables_of >> 4], tables[16 | tables_of & 15]
                for b in range(h * v):
                    block = np.zeros(64, np.int64)
                    last[c] += bits.signed(bits.symbol(dc))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        block[k] = bits.signed(s & 15)
                        k += 1
                    if c == 0:
                        luma[unit // wide * v + b // h, unit % wide * h + b % h] = block
            unit += 1
    return luma.reshape(-1, 64)


def luma_samples(jpeg: dict, coefficients: np.ndarray) -> np.ndarray:
    """8-bit luma, a row of 64 for each block."""
    steps = jpeg["quant"][jpeg["parts"][0][3]]
    natural = np.zeros(coefficients.shape)
    natural[:, ZIGZAG] = coefficients * steps
    return np.clip(np.rint(natural @ INVERSE) + 128, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, end, difference at its start) of each shot: a cut is where the difference passes both bounds."""
    found, start, peak, past = [], 0, 0.0, []
    for t in range(1, len(histograms)):
        diff = float(np.abs(histograms[t] - histograms[t - 1]).sum() / 2)
        bound = LEAST_CUT if not past else max(LEAST_CUT, float(np.mean(past)) + CUT_DEVIATIONS * float(np.std(past)))
        if diff > bound:
            found.append((start, t, peak))
            start, peak, past = t, diff, []
        else:
            past = [*past, diff][-CUT_HISTORY:]
    if len(histograms):
        found.append((start, len(histograms), peak))
    return found


def decode_media(data: bytes) -> dict:
    """Every frame of an AVI file decoded: fps, the coefficients, histograms and shots."""
    avi = read_avi(data)
    jpegs = [parse_jpeg(data[at : at + size]) for at, size in avi["frames"]]
    coefficients = [luma_coefficients(j) for j in jpegs]
    histograms = np.zeros((len(jpegs), BINS))
    for k, (j, c) in enumerate(zip(jpegs, coefficients, strict=True)):
        seen = np.bincount(luma_samples(j, c).ravel() // (256 // BINS), minlength=BINS)
        histograms[k] = seen / max(1, seen.sum())
    return avi | {"coefficients": coefficients, "histograms": histograms, "shots": shots(histograms)}


def stored_payload(media: dict) -> bytes:
    """The bytes that store_frames put into the frames."""
    held = np.concatenate(media["coefficients"]) - 512 if media["coefficients"] else np.zeros(0, np.int64)
    return held.astype(np.uint8).tobytes()[: int(media["comment"].rpartition(b"=")[2])]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def texts_as_avi(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes of the text, media: the AVI file that stores it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sources = texts(part.column(1))
                files = [write_avi(store_frames(p := padded(t)), 8 * SIDE, 8 * SIDE, comment=b"payload_bytes=%d" % len(p)) for t in sources]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sources), pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def avi_clips(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: id_col, clip, first_frame, end_frame, start_s, end_s, cut_difference. Broken media give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        m = decode_media(data or b"")
                    except (ValueError, KeyError, IndexError, struct.error):
                        continue
                    rows += [(key, n, a, b, a / m["fps"], b / m["fps"], d) for n, (a, b, d) in enumerate(m["shots"])]
                types = [part.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "clip", "first_frame", "end_frame", "start_s", "end_s", "cut_difference"])

    id_type = media.schema[id_col].dataType.simpleString()
    return media.selectExpr(f"`{id_col}` as id", f"`{media_col}` as media").mapInArrow(run, f"id {id_type}, clip int, first_frame int, end_frame int, start_s double, end_s double, cut_difference double").withColumnRenamed("id", id_col)


def avi_features(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored bytes give back: payload digests, sizes and the clips as text. Broken media give nulls."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips"]

    def row(data: bytes | None) -> tuple:
        try:
            m = decode_media(data or b"")
            payload = stored_payload(m)
        except (ValueError, KeyError, IndexError, struct.error):
            return (None,) * len(names)
        clips = ",".join(f"{a / m['fps']:.2f}-{b / m['fps']:.2f}" for a, b, _ in m["shots"])
        level = float((m["histograms"].mean(axis=0) * np.arange(BINS)).sum()) if len(m["histograms"]) else 0.0
        feature = f"frames={len(m['frames'])};fps={m['fps']:g};luma={level:.3f};clips={clips}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(m["shots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for part in slices(batch):
                rows = [row(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["id", "n_bytes", *names])

    id_type = media.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"
    return media.selectExpr(f"`{id_col}` as id", "n_bytes", f"`{media_col}` as media").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_features(texts_as_avi(table(spark, sf_dir, "documents")))
