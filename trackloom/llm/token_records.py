r"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record is one document's frame:

    length of the payload   u64, little-endian
    masked crc32 of those 8 bytes   u32
    payload: doc_id i64, has_id u8, bytes per id u8, then the ids, little-endian
    masked crc32 of the payload   u32
    0x0A

where masked(c) = rotate_right(c, 15) + 0xA282EAD8, modulo 2**32.  Files are written
by Spark's own writer, one row of frames of about `FILE_BYTES` a file, so commit, retry
and storage are Spark's; the last closing byte is that writer's line separator.
Documents are in ascending order of doc_id within and over the files.  The index is a Parquet table beside the files,
derived from what was read back: file, record, offset, length and counts of ids, with
which single records can be read in any order.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, mix, text_slices

MASK = 0xA282EAD8
HEAD, INNER = struct.Struct("<QI"), struct.Struct("<qBB")
#: Bytes of frames after which a file ends; a reader takes a file at a time.  One larger frame is a file by itself.
FILE_BYTES = 32 << 20
#: Slots of an encoder's table of pieces, half of which are filled at most, and ids that it keeps.
SLOT_BITS = 21
SLOTS, MEMO_IDS = 1 << SLOT_BITS, 6_000_000
#: Text that is encoded at once.
ENCODED_BYTES = 1 << 19
#: Longer pieces are remembered by their bytes, not in the table, which knows a piece by its ends.
SHORT_PIECE = 16


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """Without the closing byte."""
    payload = INNER.pack(doc_id or 0, doc_id is not None, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the length of the frame at `at`; ValueError if a checksum is wrong."""
    size, check = HEAD.unpack_from(data, at)
    start = at + HEAD.size
    payload = data[start : start + size]
    if check != masked(data[at : at + 8]) or len(payload) != size or struct.unpack_from("<I", data, start + size)[0] != masked(payload) or data[start + size + 4 : start + size + 5] != b"\n":
        raise ValueError(f"damaged record at byte {at}")
    doc_id, has_id, width = INNER.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=INNER.size), HEAD.size + size + 5


# Classes of bytes.  Letters are ASCII letters and both bytes of U+00C0 to U+024F.
_HARD, _SPACE, _LINE, _LETTER, _DIGIT, _MARK = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x20], _CLASS[0x0A] = _SPACE, _LINE
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x27] = _HARD  # the apostrophe may belong to the letters after it
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3:0xCA] = _LETTER


class Encoder:
    """Texts to ids by the tokenizers library, piece by piece.

    A byte-level tokenizer that splits by the usual pattern encodes each piece by
    itself: a run of letters, of digits or of other marks with one space before it,
    or a line feed.  Pieces are found for many texts at once by the classes of their
    bytes.  A text is always broken before a space that a visible character follows;
    a part between such places that holds anything unusual (an apostrophe, other white
    space, other scripts) is one piece, whatever it holds.  Each piece is encoded by
    the library once, and its ids are kept: in a table by its first and last eight bytes
    and its length, which are all of a piece of up to `SHORT_PIECE` bytes, and for longer
    ones by the bytes themselves.  Tokenizers of
    other kinds, and texts that hold an added token, encode whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.added = [x["content"].encode() for x in made["added_tokens"]]
        self.by_piece = made["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.forget()

    def forget(self) -> None:
        """Keep no pieces; the empty tables take no memory until they are written to."""
        self.keys, self.ends = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.lengths = np.zeros(SLOTS, np.uint8)  # 0: free
        self.at, self.sizes = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used, self.known = np.zeros(1 << 20, self.kind), 0, 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        raw = data.tobytes()
        if not self.by_piece or any(x in raw for x in self.added):
            ids = self.whole([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.array([x for own in ids for x in own], self.kind), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        starts = self._pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        at, sizes = self._known(data, raw, starts, ends)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        places = np.arange(total[-1]) + np.repeat(at - total[:-1], sizes)
        return self.pool[places], total[np.searchsorted(starts, offsets)]

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        if not len(data):
            return np.empty(0, np.int64)
        kind = _CLASS[data]
        after = np.append(data[1:], 0)
        kind[(data == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data == 0xC9) & (after >= 0x90)] = _HARD
        last = np.zeros(len(data), bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        following = np.append(kind[1:], 0)
        following[last] = _HARD
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        safe = (kind == _SPACE) & (following >= _LETTER)
        part = np.cumsum(safe | first) - 1
        blank = (kind == _SPACE) | (kind == _LINE)
        odd = (kind == _HARD) | (kind == _SPACE) & ~safe
        odd[1:] |= (kind[1:] == _LINE) & blank[:-1] & ~first[1:]
        hard = np.zeros(part[-1] + 1, bool)
        hard[part[odd]] = True
        # White space at a part's start meets that at the end of the part before it.
        turn = np.zeros(len(data), bool)
        turn[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        return np.flatnonzero(first | safe | turn & ~hard[part])

    def _find(self, first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each piece: where it is, or the free one where it would be."""
        slots = (mix(first ^ mix(last + length.astype(np.uint64))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        rest = np.arange(len(first))
        while len(rest):
            own = slots[rest]
            other = (self.lengths[own] != 0) & ((self.keys[own] != first[rest]) | (self.ends[own] != last[rest]) | (self.lengths[own] != length[rest]))
            rest = rest[other]
            slots[rest] = (slots[rest] + 1) % SLOTS
        return slots

    def _remember(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of pieces, encoded by the library, now are, and how many."""
        ids = self.whole([x.decode() for x in pieces])
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for own in ids for x in own], self.kind)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        begins = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.used += len(flat)
        return begins, sizes

    def _known(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids are, and how many."""
        if self.known > SLOTS // 4 or len(self.long) > SLOTS // 8 or self.used > MEMO_IDS:
            self.forget()
        size = ends - starts
        at, sizes = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        long = np.flatnonzero(size > SHORT_PIECE)
        texts = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        if fresh := [x for x in dict.fromkeys(texts) if x not in self.long]:
            self.long.update(zip(fresh, zip(*(x.tolist() for x in self._remember(fresh)), strict=True), strict=True))
        if texts:
            at[long], sizes[long] = np.array([self.long[x] for x in texts]).T

        short = np.flatnonzero(size <= SHORT_PIECE)
        if not len(short):
            return at, sizes
        padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        length = size[short].astype(np.uint8)
        spare = np.maximum(8 - length.astype(np.int64), 0).astype(np.uint64) * np.uint64(8)
        first = eight[starts[short] + 8] << spare
        last = eight[ends[short]] >> spare << spare
        slots = self._find(first, last, length)
        missing = np.flatnonzero(self.lengths[slots] == 0)
        if len(missing):
            _, own, same = np.unique(np.rec.fromarrays([first[missing], last[missing], length[missing]]), return_index=True, return_inverse=True)
            own = missing[own]
            pieces = [raw[starts[short[j]] : ends[short[j]]] for j in own]
            if self.known + len(own) > SLOTS // 2:  # more than the table takes: used once, and all is forgotten at the next call
                begins, numbers = self._remember(pieces)
                at[short], sizes[short] = self.at[slots], self.sizes[slots]
                at[short[missing]], sizes[short[missing]] = begins[same], numbers[same]
                self.known = SLOTS
                return at, sizes
            self._insert(first, last, length, own, pieces)
            slots = self._find(first, last, length)
        at[short], sizes[short] = self.at[slots], self.sizes[slots]
        return at, sizes

    def _insert(self, first: np.ndarray, last: np.ndarray, length: np.ndarray, own: np.ndarray, pieces: list[bytes]) -> None:
        begins, sizes = self._remember(pieces)
        self.known += len(own)
        rest = np.arange(len(own))
        while len(rest):  # of several that want one slot, the last gets it
            mine = own[rest]
            slots = self._find(first[mine], last[mine], length[mine])
            self.at[slots] = rest
            placed = self.at[slots] == rest
            slots, rest_placed = slots[placed], rest[placed]
            self.keys[slots], self.ends[slots], self.lengths[slots] = first[mine[placed]], last[mine[placed]], length[mine[placed]]
            self.at[slots], self.sizes[slots] = begins[rest_placed], sizes[rest_placed]
            rest = rest[~placed]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _frames(batches: Iterator[pa.RecordBatch], path: str, end_id: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row per file: its frames, with a closing byte between them."""
    coder = encoder(path)
    end = np.array([end_id], coder.kind).tobytes()
    own, size = [], 0
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for row, last, data, offsets in text_slices(batch.column("text"), ENCODED_BYTES):
            ids, at = coder.encode(data, offsets)
            for k in range(last - row):
                one = frame(doc_ids[row + k], ids[at[k] : at[k + 1]].tobytes() + end, coder.kind.itemsize)
                if own and size + len(one) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(own)], pa.binary())], ["frames"])
                    own, size = [], 0
                own.append(one)
                size += len(one) + 1
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(own)], pa.binary())], ["frames"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of docs(doc_id, text) to `path`/records and their index to `path`/index.

    tokenizer: a file of the tokenizers library, readable on every executor.  Null
    and empty texts are the end id alone.  Rows that share an id lie together, in an
    order of their texts; a null id comes first.  An empty table writes an empty index.
    """
    # The text's hash parts rows that share an id, or have none.
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    ordered = keyed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    frames = ordered.mapInArrow(lambda batches: _frames(batches, tokenizer, end_id, file_bytes), "frames binary")
    frames.select(F.col("frames").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/records")
    _read_back(docs.sparkSession, path).write.parquet(f"{path}/index")


INDEX = "file string, part int, piece int, record int, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            name = batch.column("path")[row].as_py().rsplit("/", 1)[1]
            data = batch.column("content")[row].as_py()
            part, piece = int(name.split("-")[1]), int(name.split("-c")[-1].split(".")[0])
            rows, at, before = [], 0, 0
            while at < len(data):
                doc_id, ids, length = unframe(data, at)
                rows.append((name, part, piece, len(rows), at, length, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                at, before = at + length, before + len(ids)
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_index_batches, INDEX)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`, the number of ids in all records before each one."""
    rows = spark.read.parquet(f"{path}/index")
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file", "part", "piece").agg(F.sum("n_tokens").alias("ids")).withColumn("earlier", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    return rows.join(files.select("file", "earlier"), "file").withColumn("start", F.col("earlier") + F.col("before")).drop("earlier")


def _records(key, left: pa.Table, right: pa.Table) -> pa.Table:
    data = left.column("content")[0].as_py() if left.num_rows else b""
    out = [(r["place"], *unframe(data, r["offset"])[:2]) for r in right.to_pylist()]
    return pa.table({"place": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "ids": pa.array([x[2].astype(np.int32) for x in out], pa.list_(pa.int32()))})


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """place, doc_id and ids of the records in `wanted` (rows of the index; all if none), place in an order drawn by seed."""
    rows = (index(spark, path) if wanted is None else wanted).select("file", "offset").withColumn("place", F.xxhash64("file", "offset", F.lit(seed)))
    files = _files(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return files.groupBy("file").cogroup(rows.groupBy("file")).applyInArrow(_records, "place long, doc_id long, ids array<int>").orderBy("place")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/token-records-{uuid.uuid4().hex}"
