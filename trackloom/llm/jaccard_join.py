"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. Every text gets a digest and a MinHash signature of its shingles of five words.
   Equal texts form one class at once; only its first document goes on.
2. Signatures are cut into trees, and a tree's rows are sorted by their paths.  Rows
   that share a whole path meet first; matched prefixes are shortened, one value at a
   time, until the estimated recall of those at hand reaches the target: pairs that were
   found, weighted by how likely the trees show a pair of their similarity, tell how
   many there are.  Where none was found, prefixes end as short as a pair at the
   threshold needs.  All rows that share a prefix meet; nodes beyond a part's size are
   cut into parts, and pairs of parts meet in places of their own.  Pairs whose sketches
   are far below the threshold are left out; the others tie rows into candidate groups.
3. Each candidate group is verified exactly: all pairs of its shingle sets are
   compared, by matrix products over shared shingles.  Large groups are cut into parts
   of a bounded number of texts and of bytes, and pairs of parts are compared in tasks
   of their own.
4. Links join texts into classes.

Pairs are counted where they are found and never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SOLID, Words, checkpoint, mix, text_slices, without_ids
from .graph import components, tree_edges

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.995
#: The sketch similarity that keeps a pair.
KEEP = 0.6
#: Rows in a part at most, bytes of their shingles, and rows that are broadcast at most.
PART, PART_BYTES, BROADCAST_ROWS = 2048, 64 << 20, 200_000
_SLAB = 4096
#: Rows of whole nodes from which on a task lets them meet.
_TOGETHER = 100_000
#: Rows of a node up to which pairs are taken by their distance in the batch, not as a matrix.
_FEW = 32

_RANDOM = np.random.RandomState(77)
_A = _RANDOM.randint(0, 1 << 32, TREES * DEPTH).astype(np.uint64) << np.uint64(32) | _RANDOM.randint(0, 1 << 32, TREES * DEPTH).astype(np.uint64) | np.uint64(1)
_B = _RANDOM.randint(0, 1 << 32, TREES * DEPTH).astype(np.uint64) << np.uint64(16)


def shortest_prefix(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with the wanted probability."""
    return max([1, *(k for k in range(1, DEPTH + 1) if 1 - (1 - threshold**k) ** TREES >= recall)])


def estimated_recall(pairs: dict[int, int], depth: int, threshold: float = THRESHOLD) -> float:
    """Of pairs at or above the threshold, the share found; pairs: agreeing sketch values -> pairs seen over all trees.

    A pair of similarity s meets in TREES * s**depth trees in the mean, and in any with
    probability 1 - (1 - s**depth)**TREES.  0 where no pair was seen.
    """
    found = every = 0.0
    for agreeing, n in pairs.items():
        s = min(1.0, (agreeing / (TREES * DEPTH) - 0.25) / 0.75)
        if s >= threshold:
            every += n / (TREES * s**depth)
            found += n / (TREES * s**depth) * (1 - (1 - s**depth) ** TREES)
    return found / every if every else 0.0


def _parts(n: Column) -> Column:
    """Parts of n rows: a part holds half of them, but no fewer than PART / 2 and no more than PART."""
    return F.ceil(n / F.greatest(F.lit(max(PART // 2, 1)), F.least(F.lit(PART), n / 2))).cast("int")


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles, by text; a text of fewer words, but not none, is one shingle."""
    hashes, counts = words.hashes(), words.counts()
    at, found = words.windows(hashes, SHINGLE)
    text = np.repeat(np.arange(len(counts)), counts)
    texts, out = [text[at]], [found]
    for width in range(1, SHINGLE):
        if (counts == width).any():
            k, h = words.windows(hashes, width)
            own = counts[text[k]] == width
            texts.append(text[k[own]])
            out.append(h[own])
    texts, out = np.concatenate(texts), np.concatenate(out)
    order = np.argsort(texts, kind="stable")
    return texts[order], out[order]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            text, hashes = shingles(Words(data, offsets, SOLID))
            first = np.flatnonzero(np.diff(text, prepend=-1))
            signature = np.zeros((end - row, TREES * DEPTH), np.uint16)
            if len(text):
                for k in range(TREES * DEPTH):
                    signature[text[first], k] = np.minimum.reduceat((hashes * _A[k] + _B[k]) >> np.uint64(32), first) & np.uint64(0xFFFF)
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(row, end - row),
                    "h": batch.column("h").slice(row, end - row),
                    "digest": pa.array([hashlib.sha256(raw[offsets[k] : offsets[k + 1]]).digest() for k in range(end - row)], pa.binary()),
                    "n_shingles": pa.array(np.bincount(text, minlength=end - row), pa.int64()),
                    "signature": pa.array([x.tobytes() for x in signature], pa.binary()),
                }
            )


def _sketches(signatures: np.ndarray) -> np.ndarray:
    low = (signatures & 3).astype(np.uint8).reshape(len(signatures), -1, 4)
    return low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6


def _nodes(signatures: np.ndarray, tree: int, shortest: int) -> np.ndarray:
    """Hashes of tree and prefix; nodes that share one by chance only meet in vain."""
    node = np.full(len(signatures), tree, np.uint64)
    for value in signatures[:, tree * DEPTH : tree * DEPTH + shortest].T:
        node = mix(node * _A[0] + value)
    return node.view(np.int64)


def _plant(batches: Iterator[pa.RecordBatch], shortest: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A row per text and tree: node and, if whole, the rest of its path, text and sketch."""
    for every in batches:
        for at in range(0, every.num_rows, 2000):
            batch = every.slice(at, 2000)
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
            rest = {"text_id": batch.column("text_id"), "sketch": pa.array([x.tobytes() for x in _sketches(signatures)], pa.binary())} if whole else {}
            for tree in range(TREES):
                path = {"path": pa.array([x.tobytes() for x in signatures[:, tree * DEPTH + shortest : (tree + 1) * DEPTH]], pa.binary())} if whole else {}
                yield pa.RecordBatch.from_pydict({"node": pa.array(_nodes(signatures, tree, shortest)), **path, **rest})


class _Sets:
    """Disjoint sets of ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = self.up[min(a, b)] = min(a, b)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values two sketches, as four numbers along the last axis, have in common."""
    equal = 0
    for k in range(a.shape[-1]):
        x = a[..., k] ^ b[..., k]
        equal = equal + np.bitwise_count(~(x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).astype(np.int16)
    return equal


def _least_agreeing(keep: float) -> int:
    """Two bits agree by chance in a quarter of the cases."""
    return int(np.ceil((keep * 0.75 + 0.25) * TREES * DEPTH - 1e-9))


def _meet(batches: Iterator[pa.RecordBatch], shortest: int, keep: float, threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    """Rows by (node, i, j, path): edges within each set of rows that are tied in this task, and the prefix at which it ended."""
    sets, last, ends_at = _Sets(), None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("node", "i", "j")], axis=1)
        path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint16).reshape(batch.num_rows, DEPTH - shortest)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        rows = (key, path, batch.column("part").to_numpy(), batch.column("text_id").to_numpy(), sketch)
        if last is not None:
            rows = tuple(np.concatenate(x) for x in zip(last, rows, strict=True))
        edges = np.flatnonzero((rows[0][1:] != rows[0][:-1]).any(axis=1)) + 1
        end = edges[-1] if len(edges) and len(rows[0]) >= _TOGETHER else 0  # the last node may go on in the next batch
        if end:
            ends_at.append(_shortened(sets, shortest, keep, threshold, recall, *(x[:end] for x in rows)))
        last = tuple(x[end:] for x in rows)
    if last is not None and len(last[0]):
        ends_at.append(_shortened(sets, shortest, keep, threshold, recall, *last))
    nodes = np.array(list(sets.up), np.int64)
    src, dst = tree_edges(nodes, np.array([sets.find(x) for x in sets.up], np.int64))
    for at in range(0, len(src), 10_000):
        yield pa.RecordBatch.from_pydict({"src": pa.array(src[at : at + 10_000]), "dst": pa.array(dst[at : at + 10_000]), "prefix": pa.array(np.full(len(src[at : at + 10_000]), min(ends_at)), pa.int32())})


def _shortened(sets: _Sets, shortest: int, keep: float, threshold: float, recall: float, key: np.ndarray, path: np.ndarray, part: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> int:
    """Let whole nodes' rows meet by falling prefix; the length of prefix at which the recall was reached."""
    counts = np.zeros(TREES * DEPTH + 1, np.int64)
    # The number of values of the path, beyond the node's own prefix, that a row shares with the row before it.
    same = (key[1:] == key[:-1]).all(axis=1)
    alike = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1) if path.shape[1] else np.zeros(len(same), np.int64)
    shared = np.where(same, alike, -1)
    inner = np.arange(len(key))  # rows of one inner group have met
    for depth in range(DEPTH, shortest - 1, -1):
        outer = np.concatenate([[0], np.cumsum(shared < depth - shortest)]) if len(key) else inner
        _meet_in_groups(sets, counts, keep, outer, inner, key, part, ids, sketch)
        inner = outer
        if estimated_recall(dict(enumerate(counts.tolist())), depth, threshold) >= recall:
            break
    return depth


def _meet_in_groups(sets: _Sets, counts: np.ndarray, keep: float, group: np.ndarray, met: np.ndarray, key: np.ndarray, part: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> None:
    """All pairs of rows of a group that have not met; where a node is cut into parts, of rows of its two parts."""
    least = _least_agreeing(keep)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(group)) if len(group) else starts
    few = ends - starts <= _FEW
    left = np.repeat(np.where(few, ends, 0), ends - starts) - np.arange(len(group))  # rows of the group from each one on
    whole = key[:, 1] == key[:, 2]  # parts i and j also meet within themselves, elsewhere
    for gap in range(1, _FEW):
        near = np.flatnonzero(left > gap)
        if not len(near):
            break
        near = near[(met[near] != met[near + gap]) & (whole[near] | (part[near] != part[near + gap]))]
        agreeing = _agreeing(sketch[near], sketch[near + gap])
        near, agreeing = near[agreeing >= least], agreeing[agreeing >= least]
        counts += np.bincount(agreeing, minlength=len(counts))
        for a, b in zip(ids[near].tolist(), ids[near + gap].tolist(), strict=True):
            sets.join(a, b)
    for start, end in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
        i, j = key[start, 1:]
        own = start + np.flatnonzero(part[start:end] == i)
        other = own if i == j else start + np.flatnonzero(part[start:end] == j)
        if len(own) and len(other) and (met[own[0]] != met[own[-1]] or i != j):
            alike = np.zeros((len(own), len(other)), bool)
            for k in range(0, len(own), 256):
                agreeing = _agreeing(sketch[own[k : k + 256], None], sketch[None, other])
                agreeing[met[own[k : k + 256], None] == met[None, other]] = 0
                alike[k : k + 256] = agreeing >= least
                seen = np.bincount(agreeing[alike[k : k + 256]], minlength=len(counts))
                counts += seen if i != j else seen // 2 + seen % 2
            _tie(sets, alike, ids[own].tolist(), ids[other].tolist())


def _forest(texts: DataFrame, shortest: int, keep: float, threshold: float, recall: float) -> DataFrame:
    """Edges (src, dst, prefix) that tie texts(text_id, signature) into candidate groups; rows are dealt by their shortest prefix, once."""
    signatures = texts.select("text_id", "signature")
    sizes = signatures.mapInArrow(lambda batches: _plant(batches, shortest, False), "node long").groupBy("node").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("parts", _parts(F.col("n"))).where("parts > 1").select(F.col("node").alias("large"), "parts")
    forest = signatures.mapInArrow(lambda batches: _plant(batches, shortest, True), "node long, path binary, text_id long, sketch binary")
    forest = forest.join(sizes, F.col("node") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    forest = forest.withColumn("part", F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int"))
    forest = forest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    forest = forest.select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "path", "part", "text_id", "sketch")
    forest = forest.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "path")
    return forest.mapInArrow(lambda batches: _meet(batches, shortest, keep, threshold, recall), "src long, dst long, prefix int")


def _ties(texts: DataFrame, shortest: int, keep: float, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    return _forest(texts, shortest, keep, threshold, recall).select("src", "dst")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingle hashes of each text, beside its other columns."""
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            text, hashes = shingles(Words(data, offsets, SOLID))
            cut = np.searchsorted(text, np.arange(end - row + 1))
            sets = [np.unique(hashes[cut[k] : cut[k + 1]]).tobytes() for k in range(end - row)]
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([part.column("text_id"), part.column("root"), part.column("part"), part.column("parts"), part.column("copies"), pa.array(sets, pa.binary())], ["text_id", "root", "part", "parts", "copies", "shingles"])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 64:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    common = np.intersect1d(_repeated(left), _repeated(right)) if left is not right else _repeated(left, 2)
    for at in range(0, len(common), _SLAB):
        slab = common[at : at + _SLAB]
        a = _incidence(left, slab)
        out += a @ (a if left is right else _incidence(right, slab)).T
    return out


def _repeated(sets: list[np.ndarray], least: int = 1) -> np.ndarray:
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return values[n >= least]


def _incidence(sets: list[np.ndarray], slab: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(slab)), np.float32)
    for i, s in enumerate(sets):
        own = s[np.searchsorted(s, slab[0]) : np.searchsorted(s, slab[-1], "right")]
        at = np.searchsorted(slab, own)
        out[i, at[slab[at] == own]] = 1
    return out


def _verify(group: pa.Table, threshold: float) -> pa.Table:
    """Of a pair of parts: each text's links to the other part, and an edge along the texts that it is tied to."""
    rows = {r["text_id"]: r for r in group.to_pylist()}  # a row that comes twice is one text
    parts = sorted({r["part"] for r in rows.values()})
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left = [r for r in rows.values() if r["part"] == i]
    right = left if i == j else [r for r in rows.values() if r["part"] == j]
    found = _Sets()
    links: dict[int, list[int]] = {}
    if left and right and parts:
        a = [np.frombuffer(r["shingles"], np.uint64) for r in left]
        b = a if right is left else [np.frombuffer(r["shingles"], np.uint64) for r in right]
        shared = _shared(a, b)
        every = np.array([len(x) for x in a], np.float32)[:, None] + np.array([len(x) for x in b], np.float32)[None] - shared
        linked = shared >= threshold * every - 1e-3
        if right is left:
            np.fill_diagonal(linked, False)
        copies = [np.array([r["copies"] for r in side]) for side in (left, right)]
        for side, own, other, own_linked in ((0, left, right, linked), (1, right, left, linked.T)):
            if side == 0 or right is not left:
                for k in np.flatnonzero(own_linked.any(axis=1)):
                    links[own[k]["text_id"]] = [int(own_linked[k].sum()), int(copies[1 - side][own_linked[k]].sum())]
        _tie(found, linked, [r["text_id"] for r in left], [r["text_id"] for r in right])
    ids = sorted(links)
    above = dict(zip(*(x.tolist() for x in tree_edges(np.array(ids, np.int64), np.array([found.find(x) for x in ids], np.int64))), strict=True))
    after = [above.get(x, x) for x in ids]
    return pa.table({"src": pa.array(ids, pa.int64()), "dst": pa.array(after, pa.int64()), "texts": pa.array([links[x][0] for x in ids], pa.int64()), "documents": pa.array([links[x][1] for x in ids], pa.int64())})


def _tie(found: _Sets, linked: np.ndarray, left: list[int], right: list[int]) -> None:
    """Join what is linked, one search over the matrix for each component."""
    waiting = np.flatnonzero(linked.any(axis=1)).tolist()
    seen_left, seen_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in waiting:
        edge = [start] if not seen_left[start] else []
        seen_left[start] = True
        while edge:
            k = edge.pop()
            fresh = np.flatnonzero(linked[k] & ~seen_right)
            seen_right[fresh] = True
            for m in fresh:
                found.join(left[k], right[m])
                more = np.flatnonzero(linked[:, m] & ~seen_left)
                seen_left[more] = True
                for x in more:
                    found.join(left[x], right[m])
                edge += more.tolist()


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document row: doc_id, class_id, text_id, n_texts, n_links.

    text_id is the smallest id with the same text, class_id the smallest id that
    links lead to, n_texts the number of other texts with a similarity of at least
    the threshold, and n_links the number of other documents, copies included.
    Texts are equal if their SHA-256 digests are.

    A text of one to four words has one shingle, the whole.  Null and empty texts
    have none: each such row is a class of its own (class_id is its id) without
    links.  A null id never names a class, but its row counts as a document and its
    text links others; such a row gets the class of its text, null if no row there has
    an id.  Rows that share an id count as one document with each of their texts.
    Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    signed = checkpoint(keyed.mapInArrow(_sign, "doc_id long, h long, digest binary, n_shingles long, signature binary"))
    first = [F.first(c).alias(c) for c in ("h", "n_shingles", "signature")]
    texts = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("named"), F.count("*").alias("copies"), *first)
    texts = checkpoint(texts.withColumn("text_id", F.monotonically_increasing_id()))

    groups = components(_ties(texts, shortest_prefix(threshold, recall), KEEP - (THRESHOLD - threshold), threshold, recall))
    members = checkpoint(groups.join(texts.select(F.col("text_id").alias("node"), "digest", "h", "named", "copies", "n_shingles"), "node"))
    sizes = members.groupBy(F.col("root").alias("of")).agg(F.greatest(_parts(F.count("*")), F.ceil(8 * F.sum("n_shingles") / F.lit(PART_BYTES)).cast("int")).alias("parts"))
    members = members.join(_few(checkpoint(sizes.where("parts > 1"))), F.col("root") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select(F.col("node").alias("text_id"), "root", "part", "parts", "copies", "digest", F.col("h").alias("own_h"), "named")
    same = (F.col("h") == F.col("own_h")) & F.col("doc_id").eqNullSafe(F.col("named"))
    own = keyed.join(_few(members), same).where(F.unhex(F.sha2("text", 256)) == F.col("digest")).select("text_id", "root", "part", "parts", "copies", "text")
    sets = own.mapInArrow(_sets_of, "text_id long, root long, part int, parts int, copies long, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = sets.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
    found = checkpoint(pairs.groupBy("root", "i", "j").applyInArrow(lambda group: _verify(group, threshold), "src long, dst long, texts long, documents long"))

    classes = components(found)
    named = texts.select("text_id", "digest", "named", "copies").join(classes, F.col("text_id") == F.col("node"), "left")
    names = named.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("named").alias("class_id"))
    links = found.groupBy(F.col("src").alias("linked")).agg(F.sum("texts").alias("n_texts"), F.sum("documents").alias("n_documents"))
    named = (
        named.join(links, F.col("text_id") == F.col("linked"), "left")
        .join(_few(checkpoint(names)), F.col("root") == F.col("of"), "left")
        .select(F.col("digest").alias("own_digest"), F.col("named").alias("text_id"), F.coalesce("class_id", "named").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), (F.coalesce("n_documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return signed.select("doc_id", "digest").join(named, F.col("digest") == F.col("own_digest"), "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose class has a document with a smaller id; rows with null ids stay."""
    return without_ids(docs, join(docs, **options).where("class_id < doc_id").select(F.col("doc_id").alias("id")))
