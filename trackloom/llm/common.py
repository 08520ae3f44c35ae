"""What the corpus operators share: tables, checkpoints and vectorised word hashing.

Word hashing works on the UTF-8 bytes of many texts at once.  Both word
definitions used here break words at ASCII bytes only, so the byte view and the
code-point view give the same words.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer text is a slice by itself, and goes through in pieces of this size.
SLICE_BYTES = 1 << 20
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; one of its own only where all runs on one machine."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and context.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making, on whatever storage it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint that every executor can read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs whose doc_id is not in ids(id); rows with a null id stay.

    Up to `broadcast_ids` ids, which are counted, go to the documents; more than that are joined by a shuffle.
    """
    gone = checkpoint(ids.where("id is not null").select(F.col("id").alias("gone_id")).distinct())
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone_id"], "left_anti")


# ---------------------------------------------------------------- word hashing

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.RandomState(20240607)


def _random_u64(n: int) -> np.ndarray:
    return _RANDOM.randint(0, 1 << 32, n).astype(_U) << _U(32) | _RANDOM.randint(0, 1 << 32, n).astype(_U)


_BYTE_CODES = _random_u64(256)
_STEP_CODES = _random_u64(64) | _U(1)

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words that hold no white space: `[^\x20\x09-\x0D]+`.
SOLID = ~WHITE_SPACE
#: Bytes of lower-cased normal words: digits, a-z and everything beyond ASCII.
NORMAL = np.zeros(256, bool)
NORMAL[0x30:0x3A] = NORMAL[0x61:0x7B] = NORMAL[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POWERS: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, as far as a piece needs them."""
    if not _POWERS:
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(2 * SLICE_BYTES + 1, base, _U)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=_U))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverse = _power_tables()
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], dtype=_U, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def _long_hash(data: np.ndarray) -> np.uint64:
    """Of a span beyond a piece: its pieces' hashes, folded in order."""
    cuts = np.arange(0, len(data), SLICE_BYTES)
    own = np.array([_piece_hashes(data[a : a + SLICE_BYTES], np.zeros(1, np.int64), np.array([len(data[a : a + SLICE_BYTES])]))[0] for a in cuts], _U)
    for h in own[1:]:
        own[:1] = mix(own[:1] * _U(_BASE) + h)
    return own[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end; spans come in order and do not overlap.

    Spans go through in pieces of about `SLICE_BYTES`, so that memory does not grow with the text.
    """
    out = np.empty(len(starts), _U)
    size = ends - starts
    long, short = np.flatnonzero(size > SLICE_BYTES), np.flatnonzero(size <= SLICE_BYTES)
    out[long] = [_long_hash(data[starts[k] : ends[k]]) for k in long]
    at = 0
    while at < len(short):
        first = starts[short[at]]
        end = at + int(np.searchsorted(ends[short[at:]], first + 2 * SLICE_BYTES, "right"))
        own = short[at:end]
        out[own] = _piece_hashes(data[first : ends[own[-1]]], starts[own] - first, ends[own] - first)
        at = end
    return out


class Words:
    """The words of a slice of texts.

    starts, ends: byte places in `data`; first[i]:first[i + 1] are text i's words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, self.offsets = data, offsets
        begins, stops = offsets[:-1], offsets[1:]
        starts, ends = [], []
        for at in range(0, len(data), SLICE_BYTES):
            # one byte more on either side tells whether a word goes on there; a text's edge breaks words
            low, high = max(at - 1, 0), min(at + SLICE_BYTES + 1, len(data))
            inside = kind[data[low:high]]
            n = min(SLICE_BYTES, len(data) - at)
            own = inside[at - low : at - low + n]
            before = inside[:n] if at else np.append(False, inside[: n - 1])
            after = inside[at - low + 1 : at - low + 1 + n] if high > at + n else np.append(inside[at - low + 1 :], False)
            before, after = before.copy(), after.copy()
            before[begins[(begins >= at) & (begins < at + n)] - at] = False
            after[stops[(stops > at) & (stops <= at + n)] - 1 - at] = False
            starts.append(np.flatnonzero(own & ~before) + at)
            ends.append(np.flatnonzero(own & ~after) + at + 1)
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `width` words inside one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        last = np.repeat(self.first[1:], self.counts())  # end of each word's text
        at = np.flatnonzero(np.arange(n) + width <= last[:n])
        out = np.empty(len(at), _U)
        for k in range(0, len(at), SLICE_BYTES):
            own = at[k : k + SLICE_BYTES]
            h = hashes[own] * _STEP_CODES[0]
            for j in range(1, width):
                h += hashes[own + j] * _STEP_CODES[j]
            out[k : k + SLICE_BYTES] = mix(h + _U(width))
        return at, out

    def text(self, word: int, end: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[word:end], self.ends[word:end], strict=True))


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends in that."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.starts] = 1
    mark[words.ends] -= 1
    place = np.zeros(len(out) + 1, np.int8)
    place[starts] = 1
    place[ends] -= 1
    out[np.cumsum(place[:-1], dtype=np.int8) > 0] = words.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    return out.tobytes(), starts, ends


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes, where they are, and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return arrow_text(column.fill_null(""))  # nulls that hold bytes
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def text_slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of slices of about `slice_bytes`; texts stay whole."""
    data, offsets = arrow_text(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def arrow_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and offsets."""
    kind = pa.large_string() if len(data) >= 1 << 31 else pa.string()
    width = np.int64 if kind == pa.large_string() else np.int32
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each byte place."""
    out, before = np.empty(len(places), np.int64), 0
    for at in range(0, len(data) + 1, SLICE_BYTES):
        piece = data[at : at + SLICE_BYTES]
        own = (places >= at) & (places < at + SLICE_BYTES)
        total = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
        out[own] = before + total[places[own] - at]
        before += int(total[-1])
    return out
