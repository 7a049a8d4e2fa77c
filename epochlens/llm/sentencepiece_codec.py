"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised by longest-prefix matches in the model's compiled character map while every normalised byte
keeps the source byte it came from; the normalised text is cut where no piece can span (before each run of escaped
spaces), each distinct part is segmented once per task, and the pieces are projected back to byte spans of the source.

Defined results: null and empty texts give the begin and end ids only and decode to the empty string; repeated texts give
equal rows; texts of any length are handled whole, in one task's memory; further columns are left behind (only the id is carried).
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from epochlens.llm.common import doc_texts, slices, table, texts
from epochlens.llm.ngrams import stretch_hashes

#: U+2581, which stands for a space within pieces.
SPACE = "▁"
SPACE_UTF8 = SPACE.encode()
#: Segmented parts kept by a task; the memo starts anew beyond that.
MEMO_PARTS = 1 << 20


class CharMap:
    """A compiled character map: a double-array trie over source prefixes, and the replacements they point to."""

    def __init__(self, compiled: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.replacements = compiled[4 + size :]
            # only characters that begin with one of these bytes can be replaced
            firsts = bytes(b for b in range(256) if self._step(self._child(0), b) is not None)
            self.places = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in firsts) + b"]") if firsts else None

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The unit that this byte leads to from a node's children, if there is one."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & ((1 << 31) | 0xFF) == byte else None

    def longest(self, source: bytes, at: int) -> tuple[int, int]:
        """Length of the longest source prefix at this place that the map knows, and where its replacement starts; (0, -1) if none."""
        found, node = (0, -1), self._child(0)
        for i in range(at, len(source)):
            held = self._step(node, source[i])
            if held is None:
                break
            node = self._child(held)
            if (self.units[held] >> 8) & 1:
                found = (i + 1 - at, self.units[node] & ((1 << 31) - 1))
        return found

    def apply(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the source byte that it starts from.

        What no key of the map begins with is copied in whole stretches; a replacement's bytes all come from where its prefix starts.
        """
        if not self.units or self.places is None:
            return source, np.arange(len(source) + 1)
        out, origin, copied, at = [], [], 0, 0
        while m := self.places.search(source, at):
            size, where = self.longest(source, m.start())
            at = m.start() + max(size, 1)
            if size:
                new = self.replacements[where : self.replacements.index(b"\0", where)]
                out += [source[copied : m.start()], new]
                origin += [np.arange(copied, m.start()), np.full(len(new), m.start())]
                copied = at
        out.append(source[copied:])
        origin.append(np.arange(copied, len(source) + 1))
        return b"".join(out), np.concatenate(origin)


class Codec:
    """One per Python worker; holds the model and the memo of segmented parts.

    The memo is known by 64-bit hashes of the parts (of n parts, n * n / 2**65 pairs share one: for a full memo, one in two hundred million).
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto()).normalizer_spec
        if not spec.escape_whitespaces or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only models that escape spaces, add a space in front and keep the others are handled")
        self.map = CharMap(spec.precompiled_charsmap)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character; texts can't be cut before spaces")
        #: Bytes that each piece covers, with spaces as one byte; a byte piece covers one.
        self.width = np.array([1 if self.model.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)])
        self.unknown = self.model.unk_id()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of parts, in order
        self.where = np.zeros((2, 0), np.int64)  # first place and number of each part's ids in held
        self.held = np.zeros(0, np.uint16 if len(self.width) <= 1 << 16 else np.uint32)

    def normalised(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """With one space in front, and where each byte (and the end) comes from. Spaces stay as they are; U+2581 is one as well."""
        if not source:
            return b"", np.zeros(1, np.int64)
        plain, origin = self.map.apply(source)
        if SPACE_UTF8 in plain:
            flat = np.frombuffer(plain, np.uint8)
            mark = np.flatnonzero((flat[:-2] == SPACE_UTF8[0]) & (flat[1:-1] == SPACE_UTF8[1]) & (flat[2:] == SPACE_UTF8[2]))
            origin = np.delete(origin, np.concatenate([mark + 1, mark + 2]))
            plain = plain.replace(SPACE_UTF8, b" ")
        return b" " + plain, np.concatenate([origin[:1], origin])

    def learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Segment new parts, each on its own. The library puts a space in front of what it encodes, so that one is left off; but a lone space encodes to nothing then."""
        lone = [self.model.piece_to_id(SPACE)]
        found = [ids or lone for ids in self.model.encode([p[1:].decode() for p in parts], num_threads=1)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.held) + np.cumsum(counts) - counts
        self.held = np.concatenate([self.held, np.fromiter(itertools.chain.from_iterable(found), self.held.dtype, int(counts.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.where = np.insert(self.where, at, np.stack([starts, counts]), axis=1)

    def segment(self, normal: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other and without begin and end, and where each text's begin (and the end of all)."""
        flat = b"\0".join([b"", *normal, b""])  # a part begins at a space after something else, and a text starts with a space
        data = np.frombuffer(flat, np.uint8)
        sizes = np.array([len(n) for n in normal], np.int64)
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        space = data == 0x20
        first = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        text = np.searchsorted(begins, first, side="right") - 1
        last = np.minimum(np.concatenate([first[1:], first[:0] if not len(first) else [len(flat)]]), (begins + sizes)[text])
        hashes = stretch_hashes(data, first, last)
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMO_PARTS:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            self.learn(distinct[new], [flat[a:b] for a, b in zip(first[one[new]].tolist(), last[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        starts, counts = self.where[:, at[inverse]] if len(distinct) else np.zeros((2, 0), np.int64)
        ends = np.cumsum(counts)
        ids = self.held[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(normal) + 1))]
        return ids, bounds

    def encode_all(self, sources: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, and the (start, end) source bytes of each piece; begin and end cover nothing."""
        normal = [self.normalised(s) for s in sources]
        ids, bounds = self.segment([n for n, _ in normal])
        return [self.projected(s, n, origin, ids[a:b]) for s, (n, origin), a, b in zip(sources, normal, bounds, bounds[1:], strict=False)]

    def flat_ids(self, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, and where each text's begin (and the end of all)."""
        if self.map.units:
            return self.segment([self.normalised(s)[0] for s in sources])
        return self.segment([b" " + s.replace(SPACE_UTF8, b" ") if s else b"" for s in sources])

    def encode(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_all([source])[0]

    def projected(self, source: bytes, normal: bytes, origin: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        widths = self.width[body]
        if (unknown := body == self.unknown).any():  # such a piece covers all that no other piece does
            widths = self._unknown_widths(body, widths, normal, unknown)
        ends = np.cumsum(widths)
        spans = np.zeros((len(body) + 2, 2), np.int64)
        spans[1:-1, 0], spans[1:-1, 1] = origin[ends - widths], origin[ends]
        spans[-1] = len(source)
        return np.concatenate([[self.model.bos_id()], body, [self.model.eos_id()]]).astype("<u4"), spans

    def _unknown_widths(self, body, widths, normal, unknown) -> np.ndarray:
        """With byte fallback there is none; else each unknown piece runs to where the next known one is found."""
        widths, at = widths.copy(), 0
        for i in range(len(body)):
            if unknown[i]:
                following = self.model.id_to_piece(int(body[i + 1])).replace(SPACE, " ").encode() if i + 1 < len(body) else b""
                until = normal.index(following, at + 1) if following else len(normal)
                widths[i] = until - at
            at += int(widths[i])
        return widths

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """id_col, ids array<int>, decoded text and, with spans, starts and ends array<int> (source bytes of each piece).

    model_path must be readable where tasks run, as an installed package's files are.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for part in slices(batch):
                encoded = c.encode_all(texts(part.column(1)))
                sizes = np.concatenate([[0], np.cumsum([len(i) for i, _ in encoded])]).astype(np.int32)
                wanted = [[i for i, _ in encoded], *([[s[:, 0] for _, s in encoded], [s[:, 1] for _, s in encoded]] if spans else [])]
                lists = [pa.ListArray.from_arrays(sizes, np.concatenate(x).astype(np.int32)) for x in wanted]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(i) for i, _ in encoded], pa.string()), *lists], ["id", "decoded", "ids", "starts", "ends"][: 2 + len(lists)])

    schema = f"id {id_type}, decoded string, ids array<int>" + (", starts array<int>, ends array<int>" if spans else "")
    return doc_texts(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encoded_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode_documents gives, as digests made in the same pass, so that no id leaves the Python worker."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch):
                rows = []
                sources = texts(part.column(1))
                for t, (ids, spans) in zip(sources, c.encode_all(sources), strict=True):
                    covered = bool(np.array_equal(spans[2:, 0], spans[1:-1, 1])) and int(spans[-1, 1]) == len(t)
                    rows.append((len(ids), sha(ids.tobytes()), sha(c.decode(ids).encode()), len(t), covered))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows, strict=True))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_cover_text"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_cover_text boolean").withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
