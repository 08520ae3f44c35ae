"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers.  Candidates lie in blocks of documents with a forward
index (their rows) and, for each component, the largest and smallest value.  For a
query, the sum over components of the larger of q * max and q * min bounds every
score in a block.  Each query visits the blocks of a task by falling bound and ends
when a bound falls below its k-th score; ties at the bound are still visited.

Vectors of a batch are ordered by the nearest of some of them before they are cut into
ranges, so that a block's vectors lie together.  Blocks are dealt into groups of about
`GROUP_BYTES`; every query block comes to every group, after its vectors, and is
searched as it streams by.  A query brings a score along that its k-th best has at
least, from a bounded sample of all vectors, so blocks are left out from the start in
every group.  Each group returns at most k rows a query, and these are ranked by Spark.

Bounds over vectors of random directions leave out next to nothing, whatever the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

K, SCALE = 10, 1024
BLOCK_VECTORS, CHUNK_QUERIES, LEADERS = 128, 512, 64
#: Vectors that a task holds at once.
GROUP_BYTES = 64 << 20
#: Vectors, and bytes of them, that give the first bounds of k-th scores.
SAMPLE_VECTORS, SAMPLE_BYTES = 1024, 8 << 20

_BLOCKS = "dims int, ids binary, data binary"
_EXACT = 1 << 53


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _gathered(vectors: np.ndarray) -> np.ndarray:
    """An order in which vectors with the same nearest leader lie together; leaders are every so-manieth vector."""
    leaders = vectors[:: max(1, len(vectors) // LEADERS)][:LEADERS]
    return np.argsort(np.argmax(vectors @ leaders.T - (leaders**2).sum(axis=1) / 2, axis=1), kind="stable")


def _to_blocks(batches: Iterator[pa.RecordBatch], scale: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = batch.column("embedding")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        ends = np.cumsum(sizes)
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            data = flat[(ends[rows] - dims)[:, None] + np.arange(dims)]
            order = _gathered(data)
            for at in range(0, len(rows), size):
                own = order[at : at + size]
                yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "ids": [ids[rows[own]].tobytes()], "data": [data[own].tobytes()]})


def _blocks(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    return vectors.mapInArrow(lambda batches: _to_blocks(batches, scale, size), _BLOCKS)


def _products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer inner products; values beyond 2**53 are summed as Python integers and held at the ends of a long."""
    if np.abs(queries).max(initial=0) * np.abs(block).max(initial=0) * queries.shape[1] < _EXACT:
        return (queries @ block.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(queries) @ whole(block).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        self.kth = np.full(n, -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        own_scores, own_ids = self.rows[query]
        scores, ids = np.concatenate([own_scores, scores]), np.concatenate([own_ids, ids])
        order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -(1 << 63) else -scores))[: self.k]
        self.rows[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[query] = scores[order[-1]]


class _Group:
    """Vector blocks of one number of dimensions."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]]):
        self.blocks = blocks
        self.top = np.array([b[1].max(axis=0) for b in blocks])
        self.low = np.array([b[1].min(axis=0) for b in blocks])

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[_Best, int]:
        """The k best of each query that reach `least`, and how many (query, block) pairs were scored."""
        best, visited = _Best(len(ids), k), 0
        best.kth = least.copy()
        bounds = np.maximum(queries, 0) @ self.top.T + np.minimum(queries, 0) @ self.low.T
        bounds += np.abs(bounds) * 1e-12  # rounding never hides a score
        order = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(len(self.blocks)):
            at = order[:, turn]
            open_ = np.flatnonzero(bounds[np.arange(len(ids)), at] >= best.kth)
            if not len(open_):
                break
            visited += len(open_)
            for b in np.unique(at[open_]):
                asked = open_[at[open_] == b]
                scores = _products(queries[asked], self.blocks[b][1])
                for q, row in zip(asked, scores, strict=True):
                    other = (self.blocks[b][0] != ids[q]) & (row >= best.kth[q])
                    best.add(q, row[other], self.blocks[b][0][other])
        return best, visited


def _unpack(dims: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dims)


def _first_bounds(batches: Iterator[pa.RecordBatch], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Query blocks with what each one's k-th score is at least."""
    for batch in batches:
        out = []
        for dims, ids, data in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "data")), strict=True):
            own, queries = _unpack(dims, ids, data)
            least = np.full(len(own), -np.inf)
            if dims in sample:
                least = _Group([sample[dims]]).search(own, queries, k, least)[0].kth
            out.append(least.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "least"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by (place, kind): a group's vector blocks, then query blocks, each searched as it comes."""
    place, blocks, groups = None, {}, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] != place:
                place, blocks, groups = row["place"], {}, {}
            dims = row["dims"]
            ids, vectors = _unpack(dims, row["ids"], row["data"])
            if row["kind"] == 0:
                blocks.setdefault(dims, []).append((ids, vectors))
                continue
            if dims not in blocks:
                continue
            if dims not in groups:
                groups[dims] = _Group(blocks[dims])
            best, _ = groups[dims].search(ids, vectors, k, np.frombuffer(row["least"], np.float64))
            size = [len(found) for _, found in best.rows]
            if sum(size):
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, size), "vec_id": np.concatenate([f for _, f in best.rows]), "score": np.concatenate([s for s, _ in best.rows])})


def _place(n: int) -> Column:
    """The group of a block, by its ids: running numbers of rows would fall on few of 2**k groups."""
    return F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best scores among all other rows.

    vectors(vec_id, embedding): a component x becomes floor(scale * x).  Ties go to
    the smaller vec_id.  Rows with a null id, and vectors that are null, empty or
    hold a null or non-finite component, take no part.  Only vectors of the query's
    own length are its candidates.  Rows that share the query's id are its own; other
    repeated rows each count.  A query id that occurs twice is asked once, with
    the smaller vector.  Without queries the result is empty.  An empty vector has a
    score of 0 with any other, which says nothing, so such rows take no part either.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    asked = _blocks(usable.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), scale, CHUNK_QUERIES)
    blocks = checkpoint(_blocks(usable, scale, BLOCK_VECTORS))
    total, widest = blocks.agg(F.sum(F.length("data")), F.max("dims")).first()
    n = max(-(-(total or 0) // GROUP_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample: dict[int, list] = {}
    for row in blocks.limit(min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * (widest or 1))) // BLOCK_VECTORS + 1).collect():  # bounded in vectors and bytes, up to one block
        sample.setdefault(row["dims"], []).append(_unpack(row["dims"], bytes(row["ids"]), bytes(row["data"])))
    shared = spark.sparkContext.broadcast({dims: tuple(map(np.concatenate, zip(*own, strict=True))) for dims, own in sample.items()})
    bounded = asked.mapInArrow(lambda batches: _first_bounds(batches, shared.value, k), _BLOCKS + ", least binary")
    place = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = blocks.select(_place(n).alias("place"), F.lit(0).alias("kind"), "dims", "ids", "data", F.lit(None).cast("binary").alias("least"))
    every = every.unionByName(bounded.select(place.alias("place"), F.lit(1).alias("kind"), "dims", "ids", "data", "least"))
    met = every.repartition(n, "place").sortWithinPartitions("place", "kind")
    found = met.mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
