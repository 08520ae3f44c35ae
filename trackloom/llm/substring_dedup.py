"""Substring dedup by relative Lempel-Ziv parsing: what is factored against documents before is removed.

A word goes if a window of `WIDTH` words over it also starts in a document with a
smaller id.  Documents are packed into text blocks; a block is a reference, indexed by
its windows, for what other blocks send it.

1. Each text block tells index blocks the hashes of its windows, with the least
   document that has each.  These name, for every window that another block has too, a
   block in which a smaller document has it.  Who has a window ask one another along a
   tree, `FAN` at most to one, so that a passage which a third of all documents share
   makes no block hot.
2. Text blocks send the passages that such windows cover to those blocks, each passage
   once.  What a block has from its own smaller documents it factors itself.
3. A reference block parses each passage greedily: the longest match from a place, word
   by word, is a factor; parsing goes on with the windows over the factor's boundary.
   Factors of `WIDTH` words or more go back.
4. The words that factors cover are removed.

Hashes only choose places; factors are made of equal bytes.  Windows whose hash led to
other words are looked up once more by the words themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, Words, arrow_strings, checkpoint, checkpoint_dir, spaced, text_slices

WIDTH = 13
#: Text in one text block, and text whose windows one index block holds in the mean.
TEXT_BYTES, INDEX_BYTES = 4 << 20, 12 << 20
#: Blocks that ask one block about one window, at most.
FAN = 8
#: Hashes of unequal windows that are broadcast at most; more are joined.
BROADCAST_HASHES = 1_000_000
#: Stands for a null id: such a document comes after all others.
_NO_ID = np.iinfo(np.int64).max

_BLOCKS = "block long, data binary"
#: Messages to a block: passages to parse, where a block's own passages lie, factors of them, spans to remove, hashes of unequal windows.
_MESSAGES = "block long, source long, kind int, data binary"
_PASSAGES, _PLACES, _FACTORS, _GONE, _UNEQUAL = range(5)
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<word:int,words:int>>, kept string"
_SPANS = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32())]))


def _packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: planes that hold little cost little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _framed(*parts: bytes) -> bytes:
    return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)


def _unframed(data: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.cumsum(np.frombuffer(data, np.int64, n))
    return [data[e - s : e] for s, e in zip(np.frombuffer(data, np.int64, n), ends, strict=True)]


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    block, source, kind, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "source": pa.array(source, pa.int64()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def _to_blocks(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id")
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end, data, offsets in text_slices(batch.column("text"), text_bytes):
            blob = _framed(zstandard.ZstdCompressor(level=3).compress(data.tobytes()), _packed(np.diff(offsets)), _packed(ids[row:end]), nulls[row:end].tobytes())
            yield pa.RecordBatch.from_pydict({"block": [task << 32 | n], "data": [blob]})
            n += 1


class _Text:
    """A text block's documents."""

    def __init__(self, blob: bytes):
        text, sizes, ids, nulls = _unframed(blob, 4)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(_unpacked(sizes, np.int64))])
        self.ids, self.nulls = _unpacked(ids, np.int64), np.frombuffer(nulls, bool)

    def words(self) -> Words:
        return Words(self.data, self.offsets, SOLID)


def _windows(words: Words, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, found = words.windows(words.hashes(), width)
    return at, found >> np.uint64(64 - bits) << np.uint64(64 - bits)


class _Reference(_Text):
    """A text block and its distinct windows, in the order of their hashes, each at a place in the least document that has it."""

    def __init__(self, blob: bytes, width: int, bits: int):
        super().__init__(blob)
        self.width, self.bits = width, bits
        w = self.w = self.words()
        self.at, hashes = _windows(w, width, bits)
        self.known, rank = np.unique(self.ids, return_inverse=True)
        self.row = np.repeat(np.arange(len(self.ids)), w.counts())  # of each word
        self.docs = rank[self.row[self.at]]  # of each window, as ranks of ids
        order = np.argsort(hashes, kind="stable")
        edge = np.ones(len(order), bool)
        edge[1:] = hashes[order[1:]] != hashes[order[:-1]]
        first = np.flatnonzero(edge)
        self.hashes = hashes[order[first]]
        self.entry = np.empty(len(order), np.int64)  # of each window
        self.entry[order] = np.cumsum(edge) - 1
        self.least = np.minimum.reduceat(self.docs[order], first) if len(first) else np.empty(0, np.int64)
        self.place = np.empty(len(first), np.int64)  # the first word of the window in that document
        holds = np.flatnonzero(self.docs == self.least[self.entry])[::-1]
        self.place[self.entry[holds]] = self.at[holds]

    def parts(self, n: int) -> np.ndarray:
        """Where the entries of each of n index blocks begin."""
        part = (self.hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        return np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        if not hasattr(self, "_spaced"):
            self._spaced = spaced(self.w)
        return self._spaced

    def factors(self, passages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passage, first window, windows) of factors, and hashes of windows that are nowhere where their hash leads."""
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in passages])])
        data = np.frombuffer(b"\n".join(passages) + b"\n", np.uint8)
        own = Words(data, offsets, SOLID)
        at, hashes = _windows(own, self.width, self.bits)
        entry = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        led = self.hashes[entry] == hashes if len(self.hashes) else np.zeros(len(at), bool)
        text, starts, ends = self.spaced()
        begin, stop = np.searchsorted(at, own.first[:-1]), np.searchsorted(at, own.first[1:])
        found, unequal = [], []
        for k, passage in enumerate(passages):
            i, last = int(begin[k]), int(stop[k])
            while i < last:
                n = 0
                if led[i]:
                    place = self.place[entry[i]]
                    end = self.w.first[self.row[place] + 1]  # of the reference document
                    n = _equal_words(passage, int(own.starts[at[i]] - offsets[k]), own.ends[at[i] : own.first[k + 1]] - offsets[k], text, int(starts[place]), int(ends[end - 1]))
                if n >= self.width:
                    found.append((k, i - int(begin[k]), n - self.width + 1))
                    i += n - self.width + 1  # on with the first window over the boundary
                else:
                    unequal.append(i)
                    i += 1
        three = np.array(found, np.int64).reshape(-1, 3)
        return three[:, 0], three[:, 1], three[:, 2], hashes[unequal]


def _equal_words(a: bytes, i: int, ends: np.ndarray, b: bytes, j: int, stop: int) -> int:
    """Whole words from a[i] on, ending at `ends`, that stand from b[j] on too, before `stop`."""
    most, step, same = min(len(a) - i, stop - j), 256, 0
    while same < most:
        n = min(step, most - same)
        x, y = a[i + same : i + same + n], b[j + same : j + same + n]
        if x != y:
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            same += int((x != y).argmax())
            break
        same, step = same + n, step * 4
    n = int(np.searchsorted(ends, i + same, "right"))
    # the last word is whole only if it ends in both
    while n and not (j + int(ends[n - 1]) - i == stop or b[j + int(ends[n - 1]) - i] == 32):
        n -= 1
    return n


def _entries(batches: Iterator[pa.RecordBatch], n: int, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Reference(row["data"], width, bits)
            base = block.known[:1]
            cut = block.parts(n)
            parts = np.flatnonzero(np.diff(cut))
            data = []
            for k in parts:
                own = slice(cut[k], cut[k + 1])
                data.append(_framed(base.tobytes(), _packed(np.diff(block.hashes[own], prepend=np.uint64(0))), _packed(block.known[block.least[own]] - base)))
            yield from _messages([(int(k), row["block"], _PASSAGES, x) for k, x in zip(parts, data, strict=True)]).to_batches()


def _homes(group: pa.Table) -> pa.Table:
    """One index block: for each entry of each text block, a block in which a smaller document has its hash, if any."""
    blocks = group.column("source").to_numpy()
    hashes, least = [], []
    for data in group.column("data"):
        base, h, ids = _unframed(data.as_py(), 3)
        hashes.append(np.cumsum(_unpacked(h, np.uint64), dtype=np.uint64))
        least.append(_unpacked(ids, np.int64) + np.frombuffer(base, np.int64))
    sizes = np.array([len(x) for x in hashes])
    source = np.repeat(np.arange(len(sizes)), sizes)
    hashes, least = np.concatenate(hashes), np.concatenate(least)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared = order[np.append(same, False) | np.append(False, same)]
    shared = shared[np.lexsort((source[shared], least[shared], hashes[shared]))]
    place = np.arange(len(shared))
    new = np.ones(len(shared), bool)
    new[1:] = hashes[shared[1:]] != hashes[shared[:-1]]
    other = new.copy()
    other[1:] |= least[shared[1:]] != least[shared[:-1]]
    begin = np.maximum.accumulate(np.where(new, place, 0))
    smaller = np.maximum.accumulate(np.where(other, place, 0)) - begin  # entries with a smaller document
    rank = place - begin
    asked = (rank - 1) // FAN
    asked = begin + np.where(asked < smaller, asked, rank % np.maximum(smaller, 1))
    home = np.full(len(hashes), -1)
    home[shared[smaller > 0]] = source[shared[asked[smaller > 0]]]
    rows = []
    for k, end in enumerate(np.cumsum(sizes)):
        own = home[end - sizes[k] : end]
        if (own >= 0).any():
            used, code = np.unique(own[own >= 0], return_inverse=True)
            codes = np.zeros(len(own), np.int32)
            codes[own >= 0] = code + 1
            rows.append((int(blocks[k]), group.column("block")[0].as_py(), _PASSAGES, _framed(_packed(codes), blocks[used].tobytes())))
    return _messages(rows)


def _ask(left: pa.Table, right: pa.Table, n: int, width: int, bits: int) -> pa.Table:
    """One text block: the passages it sends to others, and factors of what its own documents share."""
    if not left.num_rows:
        return _messages([])
    block, own = left.column("block")[0].as_py(), _Reference(left.column("data")[0].as_py(), width, bits)
    cut, home = own.parts(n), np.full(len(own.hashes), -1)
    for part, data in zip(right.column("source").to_pylist(), right.column("data").to_pylist(), strict=True):
        codes, used = _unframed(data, 2)
        codes, used = _unpacked(codes, np.int32), np.frombuffer(used, np.int64)
        home[cut[part] : cut[part + 1]] = np.append(used, -1)[codes - 1]
    target = home[own.entry]
    target[(target < 0) & (own.docs > own.least[own.entry])] = block
    at = np.flatnonzero(target >= 0)
    begin = np.ones(len(at), bool)
    begin[1:] = (np.diff(own.at[at]) != 1) | (target[at[1:]] != target[at[:-1]])
    begin = np.flatnonzero(begin)
    first, size = own.at[at[begin]], np.diff(np.append(begin, len(at)))
    text, starts, ends = own.spaced()
    to = target[at[begin]]
    rows, unequal = [], []
    for other in np.unique(to):
        runs, number, where = np.flatnonzero(to == other), {}, []
        for word, windows in zip(first[runs].tolist(), size[runs].tolist(), strict=True):
            where.append(number.setdefault(text[starts[word] : ends[word + windows + width - 2]], len(number)))
        where, word = np.array(where, np.int64), first[runs]
        if other == block:
            k, window, windows, fresh = own.factors(list(number))
            rows.append((block, block, _GONE, _spans(where, word, k, window, windows, width)))
            unequal.append(fresh)
        else:
            rows.append((int(other), block, _PASSAGES, zstandard.ZstdCompressor(level=3).compress(b"\n".join(number))))
            rows.append((block, int(other), _PLACES, _framed(_packed(where), _packed(word))))
    return _messages([*rows, *_unequal(block, unequal)])


def _unequal(block: int, hashes: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
    every = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    return [(block, block, _UNEQUAL, every.tobytes())] if len(every) else []


def _spans(where: np.ndarray, word: np.ndarray, k: np.ndarray, window: np.ndarray, windows: np.ndarray, width: int) -> bytes:
    """First words and numbers of words of factors, at all places of their passages."""
    order = np.argsort(where, kind="stable")
    low, high = np.searchsorted(where[order], k, "left"), np.searchsorted(where[order], k, "right")
    n = high - low
    places = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return _framed(_packed(word[places] + np.repeat(window, n)), _packed(np.repeat(windows, n) + width - 1))


def _parse(left: pa.Table, right: pa.Table, width: int, bits: int) -> pa.Table:
    """One reference block: factors of the passages it was sent."""
    if not left.num_rows or not right.num_rows:
        return _messages([])
    block, own = left.column("block")[0].as_py(), _Reference(left.column("data")[0].as_py(), width, bits)
    rows, unequal = [], []
    for source, data in zip(right.column("source").to_pylist(), right.column("data").to_pylist(), strict=True):
        k, window, windows, fresh = own.factors(zstandard.ZstdDecompressor().decompress(data).split(b"\n"))
        rows.append((source, block, _FACTORS, _framed(_packed(k), _packed(window), _packed(windows))))
        unequal.append(fresh)
    return _messages([*rows, *_unequal(block, unequal)])


def _unequal_windows(spark: SparkSession, blocks: DataFrame, messages: DataFrame, width: int, bits: int) -> DataFrame | None:
    """Spans of windows whose hash led to other words, looked up by the words themselves; None if there are none."""
    listed = messages.where(F.col("kind") == _UNEQUAL).select("data")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield pa.RecordBatch.from_pydict({"hash": pa.array(np.frombuffer(data.as_py(), np.int64))})

    hashes = checkpoint(listed.mapInArrow(numbers, "hash long").distinct())
    few = hashes.limit(BROADCAST_HASHES + 1).count()
    if not few:
        return None
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r.hash for r in hashes.collect()], np.int64).view(np.uint64))) if few <= BROADCAST_HASHES else None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Reference(row["data"], width, bits)
                text, starts, ends = own.spaced()
                every = own.hashes[own.entry]
                at = np.flatnonzero(np.isin(every, wanted.value)) if wanted else np.arange(len(every))
                word = own.at[at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array(np.full(len(at), row["block"])),
                        "word": pa.array(word),
                        "id": pa.array(own.ids[own.row[word]]),
                        "hash": pa.array(every[at].view(np.int64)),
                        "words": pa.array([text[s:e] for s, e in zip(starts[word].tolist(), ends[word + width - 1].tolist(), strict=True)], pa.binary()),
                    }
                )

    found = blocks.mapInArrow(windows, "block long, word long, id long, hash long, words binary")
    if wanted is None:
        found = found.join(hashes, "hash", "left_semi")
    least = found.groupBy(F.col("words").alias("same")).agg(F.min("id").alias("least"))
    gone = found.join(least, (F.col("words") == F.col("same")) & (F.col("least") < F.col("id"))).select("block", "word")

    def spans(group: pa.Table) -> pa.Table:
        word = group.column("word").to_numpy()
        block = group.column("block")[0].as_py()
        return _messages([(block, block, _GONE, _framed(_packed(word), _packed(np.full(len(word), width))))])

    return gone.groupBy("block").applyInArrow(spans, _MESSAGES)


def _cut(left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """One text block with all factors of its passages: what each document loses and keeps."""
    block = _Text(left.column("data")[0].as_py())
    words = block.words()
    spans, places = [], {}
    for r in right.to_pylist():
        if r["kind"] == _PLACES:
            places[r["source"]] = [_unpacked(x, np.int64) for x in _unframed(r["data"], 2)]
    for r in right.to_pylist():
        if r["kind"] == _GONE:
            spans.append(r["data"])
        elif r["kind"] == _FACTORS:
            spans.append(_spans(*places[r["source"]], *[_unpacked(x, np.int64) for x in _unframed(r["data"], 3)], width))
    change = np.zeros(len(words.starts) + 1, np.int32)
    for data in spans:
        first, size = (_unpacked(x, np.int64) for x in _unframed(data, 2))
        np.add.at(change, first, 1)
        np.add.at(change, first + size, -1)
    removed = np.cumsum(change[:-1]) > 0
    counts = words.counts()
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(removed)])
    n_removed = total[first[1:]] - total[first[:-1]]

    # Kept words with a space after each but a text's last: its byte is overwritten in a copy.
    kept = np.flatnonzero(~removed)
    text = np.repeat(np.arange(len(counts)), counts)[kept]
    inner = np.append(text[1:] == text[:-1], False)[: len(kept)]
    data = np.append(block.data, 32).astype(np.uint8)
    data[words.ends[kept[inner]]] = 32
    mark = np.zeros(len(data) + 1, np.int8)
    mark[words.starts[kept]] += 1
    np.subtract.at(mark, words.ends[kept] + inner, 1)
    stays = np.cumsum(mark[:-1], dtype=np.int8) > 0
    sizes = np.bincount(text, (words.ends - words.starts)[kept] + inner, len(counts)).astype(np.int64)

    listed: list[list[dict]] = [[] for _ in counts]
    for k in np.flatnonzero(n_removed):
        own = removed[first[k] : first[k + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        listed[k] = [{"word": int(a), "words": int(b - a)} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
    return pa.table(
        {
            "doc_id": pa.array(block.ids, pa.int64(), mask=block.nulls),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(listed, _SPANS),
            "kept": arrow_strings(data[stays], np.concatenate([[0], np.cumsum(sizes)])).cast(pa.string()),
        }
    )


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Written once to the shared folder, dealt by block, so that messages come to the blocks and these stay where they are."""
    spark, name = blocks.sparkSession, f"text_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", f"{checkpoint_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are not the catalog's
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, text_bytes: int = TEXT_BYTES, index_bytes: int = INDEX_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, spans (removed words), kept (the rest, joined by a space).

    A word goes if a window of `width` words over it also starts in a document
    with a smaller id.  Null and empty texts have no words.  Rows that share an
    id do not remove each other's words; a null id counts as larger than all
    others.  Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // index_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(-(-total // (4 * text_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _to_blocks(batches, text_bytes), _BLOCKS), buckets)
    meet = lambda messages: blocks.groupBy("block").cogroup(messages.groupBy("block"))
    entries = blocks.mapInArrow(lambda batches: _entries(batches, n, width, hash_bits), _MESSAGES)
    homes = entries.groupBy("block").applyInArrow(_homes, _MESSAGES)
    asked = checkpoint(meet(homes).applyInArrow(lambda left, right: _ask(left, right, n, width, hash_bits), _MESSAGES))
    parsed = checkpoint(meet(asked.where(F.col("kind") == _PASSAGES)).applyInArrow(lambda left, right: _parse(left, right, width, hash_bits), _MESSAGES))
    told = asked.where(F.col("kind").isin(_PLACES, _GONE)).unionByName(parsed.where(F.col("kind") == _FACTORS))
    once_more = _unequal_windows(spark, blocks, asked.unionByName(parsed), width, hash_bits)
    if once_more is not None:
        told = told.unionByName(once_more)
    return meet(told).applyInArrow(lambda left, right: _cut(left, right, width), RESULT)
