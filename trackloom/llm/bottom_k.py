"""Near duplicates by bottom-k sketches from one hash function, verified exactly.

1. A text's set of shingles is hashed once; its `RETAINED` least values are its sketch.
   Equal sets are one text from here on.
2. The `INDEXED` least values go into inverted lists.  A pair at the threshold shares a third
   of them but once in ten million, so each text needs the lists of its rarest values
   only: common passages make no long lists, unless a text has little else.
3. Star: each text meets the first text of most of its lists, and is verified against it.
   That ties a group of near copies in as many comparisons as it has texts.
4. Lists whose texts are not all tied yet are cut into parts; where two parts meet, the
   sketches of each pair that is not tied give an estimate over their union, and pairs
   that are far below the threshold are left out.
5. What remains is verified on full sets: all pairs of texts of a candidate group that no star
   has tied, by parts of bounded size.  Links tie texts into components.

Pairs are judged where they meet and never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SOLID, Words, checkpoint, text_slices
from .graph import components, tree_edges
from .jaccard_join import _few, _Sets, _shared, _tie
from .ordering import join_hot

SHINGLE, SHARE, OF = 4, 80, 100
RETAINED, INDEXED = 64, 24
#: The estimate, of RETAINED values of a union, from which on a pair is verified: over five standard errors below the threshold.
KEEP = 0.53
#: Texts in a part.
PART = 1024
_ALL = np.iinfo(np.int64).max
#: Rows of lists, and pairs, that are judged at once; lists of more than _FEW rows are judged as matrices, this many rows of a side at once.
_ROWS, _PAIRS, _FEW, _SIDE = 20_000, 20_000, 32, 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin."""
    words = Words(LOWER[data], offsets, SOLID)
    hashes, counts = words.hashes(), words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    texts, out = [], []
    for size in range(1, width + 1):
        if size == width or (counts == size).any():
            at, found = words.windows(hashes, size)
            own = slice(None) if size == width else counts[text[at]] == size
            texts.append(text[at[own]])
            out.append(found[own])
    texts, out = np.concatenate(texts), np.concatenate(out)
    order = np.lexsort((out, texts))
    texts, out = texts[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (texts[1:] != texts[:-1])
    texts, out = texts[fresh], out[fresh]
    return out, np.searchsorted(texts, np.arange(len(counts) + 1))


def _sign(batches: Iterator[pa.RecordBatch], retained: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            hashes, cut = shingle_sets(data, offsets)
            size = np.minimum(np.diff(cut), retained)
            ends = np.cumsum(size)
            least = hashes[np.repeat(cut[:-1], size) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)] >> np.uint64(1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(row, end - row),
                    "h": batch.column("h").slice(row, end - row),
                    "digest": pa.array([hashlib.sha256(hashes[cut[k] : cut[k + 1]].tobytes()).digest() for k in range(end - row)], pa.binary()),
                    "n_shingles": pa.array(np.diff(cut), pa.int64()),
                    "sketch": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(least.view(np.int64))),
                }
            )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each row's text as bytes, if it has the wanted digest, once for each (text_id, root, part) of a task."""
    seen: set[tuple] = set()
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in ("text", "digest")]
        for row, end, data, offsets in text_slices(batch.column("text")):
            hashes, cut = shingle_sets(data, offsets)
            sets = [hashes[cut[k] : cut[k + 1]].tobytes() for k in range(end - row)]
            part = batch.slice(row, end - row)
            names = list(zip(*(part.column(c).to_pylist() for c in ("text_id", "root", "part")), strict=True))
            own = []
            for k, digest in enumerate(part.column("digest").to_pylist()):
                if names[k] not in seen and hashlib.sha256(sets[k]).digest() == digest:
                    seen.add(names[k])
                    own.append(k)
            columns = [part.column(c).take(pa.array(own, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[k] for k in own], pa.binary())], [*kept, "shingles"])


def _with_sets(keyed: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(text_id, root, part, cluster) with the full set of each text."""
    named = texts.select(F.col("text_id").alias("of"), F.col("named"), F.col("h").alias("own_h"), "digest")
    wanted = checkpoint(wanted.join(named, F.col("text_id") == F.col("of")).drop("of"))
    same = (F.col("h") == F.col("own_h")) & F.col("doc_id").eqNullSafe(F.col("named"))
    own = keyed.join(_few(wanted), same).select("text_id", "root", "part", "cluster", "digest", "text")
    return own.mapInArrow(_sets_of, "text_id long, root long, part long, cluster long, shingles binary")


def _linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, share: int) -> np.ndarray:
    shared = np.rint(shared).astype(np.int64)
    return OF * shared >= share * (left[:, None] + right[None] - shared)


def _star(group: pa.Table, share: int) -> pa.Table:
    """Texts of a part that are linked with the group's first text, `root`."""
    rows = {r["text_id"]: r for r in group.to_pylist()}
    root = group.column("root")[0].as_py()
    head = rows.pop(root, None)
    found = []
    if head is not None and rows:
        own = np.frombuffer(head["shingles"], np.uint64)
        for text_id, r in rows.items():
            other = np.frombuffer(r["shingles"], np.uint64)
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            n = int((own[at] == other).sum())
            if OF * n >= share * (len(own) + len(other) - n):
                found.append(text_id)
    return pa.table({"src": pa.array(found, pa.int64()), "dst": pa.array([root] * len(found), pa.int64())})


def _verify(group: pa.Table, share: int) -> pa.Table:
    """Links between texts of two parts, of different clusters, as a forest."""
    rows = {r["text_id"]: r for r in group.to_pylist()}
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left = [r for r in rows.values() if r["part"] == i]
    right = left if i == j else [r for r in rows.values() if r["part"] == j]
    sets = _Sets()
    if left and right:
        a = [np.frombuffer(r["shingles"], np.uint64) for r in left]
        b = a if right is left else [np.frombuffer(r["shingles"], np.uint64) for r in right]
        linked = _linked(_shared(a, b), np.array([len(x) for x in a]), np.array([len(x) for x in b]), share)
        linked &= np.array([r["cluster"] for r in left])[:, None] != np.array([r["cluster"] for r in right])[None]
        _tie(sets, linked, [r["text_id"] for r in left], [r["text_id"] for r in right])
    return _forest_of(sets)


def _forest_of(sets: _Sets) -> pa.Table:
    nodes = np.array(list(sets.up), np.int64)
    src, dst = tree_edges(nodes, np.array([sets.find(x) for x in sets.up], np.int64))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _last(sketch: np.ndarray, size: np.ndarray, retained: int) -> np.ndarray:
    """The value up to which a sketch has all of its set."""
    return np.where(size < retained, _ALL, sketch[np.arange(len(sketch)), np.maximum(size, 1) - 1])


def estimates(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, retained: int) -> np.ndarray:
    """Row by row, the similarity of two sets from the part of their union that both sketches (padded with the greatest long) hold."""
    upto = np.minimum(_last(a, sizes_a, retained), _last(b, sizes_b, retained))[:, None]
    n_a, n_b = ((a <= upto) & (a < _ALL)).sum(axis=1), ((b <= upto) & (b < _ALL)).sum(axis=1)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _ALL)).sum(axis=1)
    return common / np.maximum(n_a + n_b - common, 1)


def _meet(batches: Iterator[pa.RecordBatch], keep: float, retained: int) -> Iterator[pa.RecordBatch]:
    """Rows by (value, i, j): pairs of different clusters whose estimate reaches `keep`, as a forest."""
    sets, held = _Sets(), None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("value", "i", "j")], axis=1)
        sketches = batch.column("sketch")
        size = np.diff(sketches.offsets.to_numpy())
        matrix = np.full((batch.num_rows, retained), _ALL, np.int64)
        matrix[np.arange(retained)[None] < size[:, None]] = sketches.flatten().to_numpy()
        rows = (key, batch.column("part").to_numpy(), batch.column("text_id").to_numpy(), batch.column("cluster").to_numpy(), matrix, size)
        held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        edges = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1)) + 1
        if len(edges) and len(held[0]) >= _ROWS:  # the last list may go on in the next batch
            _meet_in_lists(sets, keep, retained, *(x[: edges[-1]] for x in held))
            held = tuple(x[edges[-1] :] for x in held)
    if held is not None and len(held[0]):
        _meet_in_lists(sets, keep, retained, *held)
    yield from _forest_of(sets).to_batches()


def _meet_in_lists(sets: _Sets, keep: float, retained: int, key: np.ndarray, part: np.ndarray, ids: np.ndarray, cluster: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> None:
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    ends = np.append(starts[1:], len(key))
    few = ends - starts <= _FEW
    left = np.repeat(np.where(few, ends, 0), ends - starts) - np.arange(len(key))
    pairs = []
    for gap in range(1, _FEW):
        near = np.flatnonzero(left > gap)
        if not len(near):
            break
        whole = key[near, 1] == key[near, 2]
        near = near[(cluster[near] != cluster[near + gap]) & (whole | (part[near] != part[near + gap]))]
        pairs.append(np.stack([near, near + gap], axis=1))
    _judged(sets, keep, retained, pairs, ids, sketch, size)
    for start, end in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
        i, j = key[start, 1:]
        own = start + np.flatnonzero(part[start:end] == i)
        other = own if i == j else start + np.flatnonzero(part[start:end] == j)
        names, n = np.unique(cluster[start:end], return_counts=True)
        tied = names[np.argmax(n)]  # texts of the largest cluster need not meet each other
        loose = own[cluster[own] != tied]
        sides = [(loose, other)] if i == j else [(loose, other), (own[cluster[own] == tied], other[cluster[other] != tied])]
        for x, y in sides:
            for k in range(0, len(x), _SIDE):
                z = x[k : k + _SIDE]
                near = (_estimated(sketch[z], sketch[y], size[z], size[y], retained) >= keep) & (cluster[z][:, None] != cluster[y][None])
                _tie(sets, near, ids[z].tolist(), ids[y].tolist())


def _estimated(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, retained: int) -> np.ndarray:
    """`estimates` of all rows of one side with all of the other."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    left, right = [x[:n] for x, n in zip(a, sizes_a, strict=True)], [x[:n] for x, n in zip(b, sizes_b, strict=True)]
    common = _shared(left, right)
    last_a, last_b = _last(a, sizes_a, retained), _last(b, sizes_b, retained)
    n_a = np.array([np.searchsorted(x, np.minimum(last_b, last), "right") for x, last in zip(left, last_a, strict=True)])
    n_b = np.array([np.searchsorted(x, np.minimum(last_a, last), "right") for x, last in zip(right, last_b, strict=True)]).T
    return common / np.maximum(n_a + n_b - common, 1)


def _judged(sets: _Sets, keep: float, retained: int, pairs: list[np.ndarray], ids: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Tie the pairs that reach `keep`; pairs whose sizes or ties say enough are not looked at."""
    every = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    for at in range(0, len(every), _PAIRS):
        a, b = every[at : at + _PAIRS].T
        near = estimates(sketch[a], sketch[b], size[a], size[b], retained) >= keep
        for x, y in zip(ids[a[near]].tolist(), ids[b[near]].tolist(), strict=True):
            sets.join(x, y)
    return []


def _postings(texts: DataFrame, indexed: int) -> tuple[DataFrame, DataFrame]:
    """listed(value, text_id, df): the lists of each text's rarest values; stars(text_id, root): the first text of at least half of them."""
    posts = texts.select("text_id", F.explode(F.slice("sketch", 1, indexed)).alias("value"))
    lists = checkpoint(posts.groupBy("value").agg(F.count("*").alias("df"), F.min("text_id").alias("first")).where("df > 1"))
    found = join_hot(posts, lists, ["value"], "df")
    own = found.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("df", "value", "first"))).alias("own"))
    own = own.join(texts.select(F.col("text_id").alias("of"), F.least(F.size("sketch"), F.lit(indexed)).alias("m")), F.col("text_id") == F.col("of"))
    alone = F.col("m") - F.size("own")  # values that no other text has are the rarest
    needed = F.greatest(F.col("m") - F.ceil(F.col("m") / 3) + 1 - alone, F.lit(0)).cast("int")
    own = checkpoint(own.select("text_id", F.slice("own", F.lit(1), needed).alias("own")).where(F.size("own") > 0))
    listed = own.select("text_id", F.inline("own")).select("value", "text_id", "df")
    firsts = F.filter(F.transform("own", lambda x: x["first"]), lambda x: x != F.col("text_id"))
    counted = F.transform(F.array_distinct("firsts"), lambda x: F.struct(F.size(F.filter("firsts", lambda y: y == x)).alias("n"), (-x).alias("first")))
    stars = own.select("text_id", F.size("own").alias("lists"), firsts.alias("firsts")).where(F.size("firsts") > 0)
    stars = stars.select("text_id", "lists", F.array_max(counted).alias("most")).where("2 * most.n >= lists")
    return listed, stars.select("text_id", (-F.col("most.first")).alias("root"))


def _numbered_parts(members: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """members(text_id, root, cluster) with their part; pairs(root, i, j) of parts that hold texts of different clusters.

    A cluster of more than a part has parts of its own, and these do not meet each other; the rest is mixed.
    """
    sizes = members.groupBy("root", "cluster").agg(F.count("*").alias("n"))
    mixed = sizes.where(F.col("n") <= part).groupBy("root").agg(F.ceil(F.sum("n") / part).cast("long").alias("mixed"))
    own = sizes.join(mixed.withColumnRenamed("root", "of"), F.col("root") == F.col("of"), "left").select(F.col("root").alias("of"), F.col("cluster").alias("of_cluster"), "n", "mixed")
    dealt = join_hot(members, own.withColumnsRenamed({"of": "root", "of_cluster": "cluster"}), ["root", "cluster"], "n")
    large = F.col("n") > part
    place = F.when(large, F.pmod(F.xxhash64("text_id"), F.ceil(F.col("n") / part))).otherwise(F.pmod(F.xxhash64("cluster", "text_id"), F.col("mixed")))
    number = F.xxhash64(F.when(large, F.col("cluster")), place)
    dealt = checkpoint(dealt.select("text_id", "root", "cluster", number.alias("part")))
    parts = dealt.groupBy("root", "part").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    other = parts.toDF("of", "j", "other_low", "other_high")
    met = parts.join(other, (F.col("root") == F.col("of")) & (F.col("part") <= F.col("j")))
    met = met.where("least(low, other_low) < greatest(high, other_high)")
    return dealt, checkpoint(met.select("root", F.col("part").alias("i"), "j"))


def near_duplicates(docs: DataFrame, share: int = SHARE, keep: float = KEEP, retained: int = RETAINED, indexed: int = INDEXED, part: int = PART) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Words are what white space parts, with A-Z in lower case.  Links join documents whose
    sets of shingles of four words have a similarity of `share` percent or more; a text of one to three words
    has one shingle, the whole.  Null, empty and wordless texts have none and are linked with
    nothing.  component_id is the smallest id that links lead to.  Rows that share an id have each
    their own text's component; a row with a null id links others but never names a component, so its
    own is null where no other row of it has an id, and it is never kept.  Shingles are equal if
    their hashes of 64 bits are.  Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    signed = checkpoint(keyed.mapInArrow(lambda batches: _sign(batches, retained), "doc_id long, h long, digest binary, n_shingles long, sketch array<long>"))
    name = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("name")
    texts = signed.where("n_shingles > 0").groupBy("digest").agg(name, F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    texts = checkpoint(texts.select("digest", F.col("name.doc_id").alias("named"), F.col("name.h").alias("h"), "copies", "sketch", F.monotonically_increasing_id().alias("text_id")))

    listed, stars = _postings(texts, indexed)
    stars = checkpoint(stars)
    heads = stars.groupBy("root").agg(F.ceil(F.count("*") / part).alias("parts"))
    dealt = join_hot(stars, heads.withColumn("rows", F.col("parts") * part), ["root"], "rows")
    dealt = dealt.select("text_id", "root", F.pmod(F.xxhash64("text_id"), F.col("parts")).alias("part"))
    heads = heads.select(F.col("root").alias("text_id"), "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = dealt.unionByName(heads).withColumn("cluster", F.lit(0).cast("long"))
    tied = checkpoint(_with_sets(keyed, texts, wanted).groupBy("root", "part").applyInArrow(lambda group: _star(group, share), "src long, dst long"))
    clusters = components(tied).select(F.col("node").alias("of"), F.col("root").alias("star"))
    own = checkpoint(listed.join(clusters, F.col("text_id") == F.col("of"), "left").select("value", "text_id", F.coalesce("star", "text_id").alias("cluster")))

    open_lists = own.groupBy("value").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("n")).where("low < high")
    open_lists = checkpoint(open_lists.select("value", "n", F.ceil(F.col("n") / part).alias("parts")))
    rows = join_hot(own, open_lists, ["value"], "n").withColumn("part", F.pmod(F.xxhash64("text_id"), F.col("parts")))
    rows = rows.join(texts.select(F.col("text_id").alias("of"), "sketch"), F.col("text_id") == F.col("of")).drop("of")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "text_id", "cluster", "sketch")
    rows = rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
    groups = components(rows.mapInArrow(lambda batches: _meet(batches, keep, retained), "src long, dst long"))

    members = groups.join(clusters, F.col("node") == F.col("of"), "left").select(F.col("node").alias("text_id"), "root", F.coalesce("star", "node").alias("cluster"))
    dealt, pairs = _numbered_parts(checkpoint(members), part)
    sets = _with_sets(keyed, texts, dealt)
    sides = pairs.select("root", F.col("i").alias("part"), "i", "j").unionByName(pairs.where("i <> j").select("root", F.col("j").alias("part"), "i", "j"))
    sides = sides.withColumnsRenamed({"root": "of", "part": "of_part"})
    met = sets.join(sides, (F.col("root") == F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")
    found = met.groupBy("root", "i", "j").applyInArrow(lambda group: _verify(group, share), "src long, dst long")

    classes = components(tied.unionByName(found))
    named = checkpoint(texts.select("text_id", "digest", "named", "copies").join(classes, F.col("text_id") == F.col("node"), "left"))
    names = named.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("named").alias("least"))
    named = checkpoint(named.join(names, F.col("root") == F.col("of"), "left").select("digest", F.coalesce("least", "named").alias("component_id"), "copies"))
    out = join_hot(signed.where("n_shingles > 0").select("doc_id", "n_shingles", "digest"), named, ["digest"], "copies").select("doc_id", "n_shingles", "component_id")
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
