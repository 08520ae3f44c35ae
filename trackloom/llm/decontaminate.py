"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of the benchmark are hashed once and broadcast; every document is
scanned in one pass over its own bytes, without a shuffle.  A hash that meets
the set is confirmed by comparing the words themselves.

The benchmark is a fixed set of test items, not a table that grows with the
corpus; still its size is checked.  Items are read in blocks of at most `BLOCK_BYTES`
of text.  A block is kept as arrays, of 40 bytes a window at most, beside its text; a
word has a byte and a break of a byte at least, so a block takes at most 21 times its
text, 84 MB.  One block is one broadcast; more blocks mean more scans, whose hits are
merged by document row, so no size of benchmark is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, NORMAL, Words, checkpoint, code_points, spaced, text_slices

WINDOW = 13
#: Benchmark text in one broadcast.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22

#: A span holds its first and last word's place, and the same in code points, end exclusive.
_SPAN = "struct<start:int,end:int,word:int,words:int>"
FOUND = f"n_words long, n_hit long, items array<string>, spans array<{_SPAN}>"
_SPANS = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "word", "words")]))


class _Windows:
    """The distinct windows of one length, in the order of their hashes: where their words lie, and whose they are."""

    def __init__(self, text: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        hashes, start, end, item = hashes[order], start[order], end[order], item[order]
        number = np.arange(len(order))
        for k in np.flatnonzero(hashes[1:] == hashes[:-1]) + 1:
            first = int(np.searchsorted(hashes, hashes[k]))
            own = text[start[k] : end[k]]
            number[k] = next((j for j in dict.fromkeys(number[first:k].tolist()) if text[start[j] : end[j]] == own), k)
        kept, number = np.unique(number, return_inverse=True)
        self.hashes, self.start, self.end = hashes[kept], start[kept], end[kept]
        pairs = np.unique(np.stack([number, item], axis=1), axis=0)
        self.first, self.item = np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), pairs[:, 1].astype(np.int32)
        self.near = np.zeros(1 << _FILTER_BITS, bool)
        self.near[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True


class NgramSet:
    """Windows of one block of items, by length; all words lie in one buffer."""

    def __init__(self, items: list[tuple], width: int = WINDOW):
        usable = sorted((str(item_id), text) for item_id, text in items if item_id is not None and text)
        self.names = sorted({name for name, _ in usable})
        number = {name: k for k, name in enumerate(self.names)}
        texts, found, base = [], {}, 0
        for name, text in usable:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            words = Words(data, np.array([0, len(data)]), NORMAL)
            if n := len(words.starts):
                size = min(n, width)
                own, starts, ends = spaced(words)
                at, hashes = words.windows(words.hashes(), size)
                found.setdefault(size, []).append((hashes, base + starts[at], base + ends[at + size - 1], np.full(len(at), number[name])))
                texts.append(own)
                base += len(own)
        self.text = b"".join(texts)
        self.sizes = {size: _Windows(self.text, *(np.concatenate(x) for x in zip(*parts, strict=True))) for size, parts in found.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, window length, items) of each confirmed window."""
        if not len(words.starts):
            return
        hashes = words.hashes()
        for size, known in self.sizes.items():
            at, found = words.windows(hashes, size)
            maybe = np.flatnonzero(known.near[found >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(known.hashes, found[maybe]), np.searchsorted(known.hashes, found[maybe], "right")
            hit = high > low
            for k, a, b in zip(at[maybe[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                own = words.text(k, k + size)
                for j in range(a, b):
                    if self.text[known.start[j] : known.end[j]] == own:
                        yield k, size, [self.names[x] for x in known.item[known.first[j] : known.first[j + 1]]]
                        break


def _scan_batches(batches: Iterator[pa.RecordBatch], ngrams: NgramSet, text: str, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns `carried` come along; `items` and `spans` of earlier blocks, if there, are added to."""
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(text)):
            words = Words(LOWER[data], offsets, NORMAL)
            change = np.zeros(len(words.starts) + 1, np.int32)
            items: list[set[str]] = [set() for _ in range(end - row)]
            if "spans" in batch.schema.names:
                for k in range(row, end):
                    items[k - row].update(batch.column("items")[k].as_py())
                    for span in batch.column("spans")[k].as_py():
                        change[words.first[k - row] + span["word"]] += 1
                        change[words.first[k - row] + span["word"] + span["words"]] -= 1
            for first, size, ids in ngrams.hits(words):
                change[first] += 1
                change[first + size] -= 1
                items[int(np.searchsorted(words.first, first, "right")) - 1].update(ids)
            hit = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            spans: list[list[dict]] = [[] for _ in range(end - row)]
            for k in np.flatnonzero(n_hit):
                a, b = words.first[k], words.first[k + 1]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                first, last = edges[0::2], edges[1::2] - 1
                own = data[offsets[k] : offsets[k + 1]]
                starts = code_points(own, words.starts[a + first] - offsets[k])
                ends = code_points(own, words.ends[a + last] - offsets[k])
                spans[k] = [dict(zip(("start", "end", "word", "words"), map(int, x), strict=True)) for x in zip(starts, ends, first, last - first + 1, strict=True)]
            columns = {name: batch.column(name).slice(row, end - row) for name in carried}
            columns |= {
                "n_words": pa.array(words.counts(), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "spans": pa.array(spans, _SPANS),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks, cut where a running sum of their bytes passes `block_bytes`; a larger item is a block by itself.

    Items stream to the driver, which holds one block; there is one block at least, and none is empty but that of an empty table.
    """
    block, size = [], 0
    for item_id, text, n in benchmark.where(F.length("text") > 0).select("item_id", "text", F.octet_length("text")).toLocalIterator():
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, carried: list[str]) -> DataFrame:
    """A row per document row: n_words, n_hit, items, spans, and the columns `carried` of docs as c0, c1, ..."""
    sc = docs.sparkSession.sparkContext
    places = {name: f"c{k}" for k, name in enumerate([*carried, *(["text"] if "text" not in carried else [])])}
    found = docs.select(*[F.col(name).alias(place) for name, place in places.items()])
    kinds, more = {f.name: f for f in found.schema}, StructType.fromDDL(FOUND).fields
    for items, last in _numbered(_blocks(benchmark, block_bytes)):
        kept = [places[name] for name in (carried if last else places)]
        shared = sc.broadcast(NgramSet(items, width))
        found = found.mapInArrow(_scanner(shared, places["text"], kept), StructType([*(kinds[c] for c in kept), *more]))
        if not last:
            found = checkpoint(found)
    return found


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items, spans.

    Null and empty texts have no words and no hits; items without words or with
    a null id or text have no windows; equal items are all named; repeated rows
    are each scanned.  Other columns of either table are not read.  With an empty
    benchmark nothing is hit.
    """
    return _scanned(docs, benchmark, width, block_bytes, ["doc_id"]).select(F.col("c0").alias("doc_id"), "n_words", "n_hit", "items", "spans")


def _scanner(shared, text: str, carried: list[str]):
    return lambda batches: _scan_batches(batches, shared.value, text, carried)


def _numbered(blocks: Iterator[list[tuple]]) -> Iterator[tuple[list[tuple], bool]]:
    """Each block, and whether it is the last."""
    before = next(blocks)
    for block in blocks:
        yield before, False
        before = block
    yield before, True


def is_contaminated(share: int = 20) -> F.Column:
    """At least one word in `share` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, unchanged; each row is judged by its own text, where it is, so nothing is shuffled.

    A row with a null id is never dropped, as nothing can name it in a report.
    """
    named = f"c{docs.columns.index('doc_id')}"
    kept = _scanned(docs, benchmark, width, block_bytes, docs.columns).where(~is_contaminated() | F.col(named).isNull())
    return kept.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit spans cut out of each text; the rest of a text, and other columns, stay as they are."""
    found = _scanned(docs, benchmark, width, block_bytes, docs.columns)
    text = f"c{docs.columns.index('text')}"
    cut = F.expr(
        f"concat(aggregate(spans, named_struct('done', 0, 'kept', ''), (a, s) -> named_struct('done', s.end, 'kept', "
        f"concat(a.kept, substring({text}, a.done + 1, s.start - a.done))), a -> a.kept), substring({text}, element_at(spans, -1).end + 1))"
    )
    whole = found.withColumn(text, F.when(F.col("n_hit") > 0, cut).otherwise(F.col(text)))
    return whole.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])
