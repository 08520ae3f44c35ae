"""The trie of all prefixes of conversations, by rolling fingerprints.

1. A turn becomes a digest of its role and text, and its number of code points; texts
   are read once and go no further.  Turns are placed by conversation in ranges, so a
   conversation may hold any share of the rows.
2. Conversations are rebuilt from places: a few turns of another one, then their own.
3. NumPy scans blocks of `BLOCK` turns for polynomial fingerprints of all prefixes, in
   two lanes of 64 bits; blocks after the first carry the sums of those before.
4. Prefixes of one depth and fingerprint are a candidate group; the smallest conversation
   represents it.  A group stands if each member's last turn, and the group of the prefix
   before it, equal the representative's; by induction all turns then do.  Least and
   greatest parts of digests tell which groups stand, so a group of any size is summed
   up before the shuffle.  In the others rows are compared with their representative, and those
   that differ become a group of their own, again and again.
5. A node belongs to its representative, whose own prefixes are all the nodes above it.
   So what a subtree sums up is rolled up along each conversation, then over the members of
   each node, without a round per depth.
6. The conversations that end at a node are listed in order as pieces of text, and hashed
   as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .ordering import groups_of, join_hot, placed

#: Turns that are scanned at once, and bytes of ids that are handed on at once.
BLOCK, PIECE_BYTES = 4096, 1 << 20

_RANDOM = np.random.RandomState(1861)
_BASES = [int(x) * 8 + 5 for x in _RANDOM.randint(1 << 40, 1 << 60, 2, dtype=np.int64)]
_KEY = ["depth", "k1", "k2", "k3"]
_UP = ["up", "p1", "p2", "p3"]
_TURN = ["t0", "t1", "t2", "t3"]


def turn_digest(role: Column, text: Column) -> Column:
    """The packed digest of a turn; nulls as empty texts."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _rebuilt(conversations: DataFrame, other: Column, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, depth, length, chars, digest) of rebuilt conversations, and conversations(conv_id, length)."""
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    turns = placed(checkpoint(own), ["conv_id", "turn", "digest", "row"])
    groups = checkpoint(groups_of(turns, "conv_id"))
    convs = groups.where("before = 0").select("conv_id", F.col("total").alias("n"), other.cast("long").alias("other"), borrowed.cast("long").alias("h"))
    lent = convs.select(F.col("conv_id").alias("lender"), F.col("n").alias("lendable"))
    convs = convs.join(lent, F.col("other") == F.col("lender"), "left").withColumn("k", F.least("h", F.coalesce("lendable", F.lit(0))))
    convs = checkpoint(convs.select("conv_id", "other", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    known = groups.join(convs.select(F.col("conv_id").alias("of"), "h", "k", "length"), F.col("conv_id") == F.col("of"))
    known = known.select(F.col("part").alias("in_part"), "of", "first", "before", "h", "k", "length")
    numbered = turns.join(known, (F.col("part") == F.col("in_part")) & (F.col("conv_id") == F.col("of")))
    numbered = numbered.withColumn("place", F.col("spot") - F.col("first") + F.col("before"))
    kept = numbered.where("place >= h").select("conv_id", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), "length", "chars", "digest")
    wanted = convs.where("k > 0").select("conv_id", "length", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("wanted"))
    lenders = numbered.select(F.col("conv_id").alias("lender"), "place", "chars", "digest")
    lent = wanted.join(lenders, (F.col("other") == F.col("lender")) & (F.col("wanted") == F.col("place")))
    return kept.unionByName(lent.select("conv_id", (F.col("wanted") + 1).alias("depth"), "length", "chars", "digest")), convs


def _scan(batches: Iterator[pa.RecordBatch], block: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows by (conversation, block, depth): fingerprints within the block after (k) and before (p) each turn, and the parts of its digest."""
    powers = []
    for base in _BASES:
        steps = np.full(block, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    mask = np.uint64((1 << bits) - 1)
    last, carry = None, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
        parts = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
        place = (depth - 1) // block
        begins = np.append((conv[0], place[0]) != last, (conv[1:] != conv[:-1]) | (place[1:] != place[:-1]))
        starts = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        out = {c: batch.column(c) for c in ("conv_id", "depth", "length", "chars")}
        for lane in range(2):
            terms = parts[:, lane] * powers[lane][(depth - 1) % block]
            total = np.cumsum(terms, dtype=np.uint64)
            before = np.concatenate([np.zeros(1, np.uint64), total])
            # the sum before a row's own block begins; a block that goes on from the last batch has its carry
            base = np.where(group >= 0, before[starts][np.maximum(group, 0)] if len(starts) else np.uint64(0), np.uint64(0) - carry[lane])
            after, prior = total - base, before[:-1] - base
            carry[lane] = after[-1]
            out[f"k{lane + 1}"] = pa.array((after & mask).view(np.int64))
            out[f"p{lane + 1}"] = pa.array((prior & mask).view(np.int64))
        last = (conv[-1], place[-1])
        for k, name in enumerate(_TURN):
            out[name] = pa.array(parts[:, k].copy().view(np.int64))
        yield pa.RecordBatch.from_pydict(out)


def _prefixes(turns: DataFrame, convs: DataFrame, block: int, bits: int) -> DataFrame:
    """A row per prefix of each conversation, the empty one included: its key, its parent's key and the parts of its last turn."""
    place = F.floor((F.col("depth") - 1) / block)
    dealt = turns.repartition("conv_id", place).sortWithinPartitions("conv_id", "depth")
    columns = "conv_id long, depth long, length long, chars long, k1 long, p1 long, k2 long, p2 long, t0 long, t1 long, t2 long, t3 long"
    scanned = checkpoint(dealt.mapInArrow(lambda batches: _scan(batches, block, bits), columns))
    short, long = scanned.where(F.col("length") <= block), scanned.where(F.col("length") > block).withColumn("place", place)
    ends = long.where(F.col("depth") % block == 0)
    so_far = Window.partitionBy("conv_id").orderBy("place")
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).over(so_far.rowsBetween(Window.unboundedPreceding, upto)) for c in ("k1", "k2") for upto in (0, -1)]
    carried = ends.select(F.col("conv_id").alias("of"), (F.col("place") + 1).alias("next"), *[F.col(c).alias(f"end_{c}") for c in ("k1", "k2")], *[s.alias(n) for s, n in zip(sums, ("sum1", "prior1", "sum2", "prior2"), strict=True)])
    long = long.join(carried, (F.col("conv_id") == F.col("of")) & (F.col("place") == F.col("next")), "left")
    for lane in ("1", "2"):
        key = F.when(F.col(f"sum{lane}").isNull(), F.col(f"k{lane}")).otherwise(F.xxhash64(f"k{lane}", f"sum{lane}"))
        edge = F.when(F.col(f"prior{lane}").isNull(), F.col(f"end_k{lane}")).otherwise(F.xxhash64(f"end_k{lane}", f"prior{lane}"))
        first = F.col(f"sum{lane}").isNotNull() & (F.col("depth") % block == 1 % block)
        before = F.when(first, edge).when(F.col(f"sum{lane}").isNull(), F.col(f"p{lane}")).otherwise(F.xxhash64(f"p{lane}", f"sum{lane}"))
        long = long.withColumn(f"new_k{lane}", key).withColumn(f"p{lane}", before)
    long = long.drop("k1", "k2").withColumnsRenamed({"new_k1": "k1", "new_k2": "k2"}).select(*short.columns)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "length", *[zero.alias(c) for c in ("chars", "k1", "p1", "k2", "p2", *_TURN)])
    return short.unionByName(long).unionByName(roots).withColumn("k3", zero).withColumn("p3", zero).withColumn("up", F.col("depth") - 1)


def _groups(rows: DataFrame) -> DataFrame:
    """A row per key: its representative, members, members that end there, whether all agree with the representative, and what they agree on."""
    alike = [*_TURN, "p1", "p2", "p3"]
    stands = F.lit(True)
    for c in alike:
        stands = stands & (F.min(c) == F.max(c))
    return rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), stands.alias("stands"), F.min("chars").alias("node_chars"), F.min("up").alias("up"), *[F.min(c).alias(c) for c in ("p1", "p2", "p3")]
    )


def _split(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with k3 and p3 so that all groups stand."""
    alike = [*_TURN, "p1", "p2", "p3"]
    while not (bad := groups.where("not stands").select(*_KEY, "rep", "n_convs")).isEmpty():
        held = [F.col(c).alias(f"of_{c}") for c in _KEY]
        same = [F.col(c) == F.col(f"of_{c}") for c in _KEY]
        heads = bad.select(*held, "rep", F.col("n_convs").alias("most")).join(rows, [*same, F.col("rep") == F.col("conv_id")])
        heads = checkpoint(heads.select(*_KEY, "most", F.lit(1).alias("seen"), *[F.col(c).alias(f"rep_{c}") for c in alike]))
        met = join_hot(rows, heads, _KEY, "most", "left")
        differs = F.lit(False)
        for c in alike:
            differs = differs | (F.col(c) != F.col(f"rep_{c}"))
        moved = checkpoint(met.withColumn("k3", F.col("k3") + F.when(F.col("seen").isNotNull() & differs, 1).otherwise(0)).select(*rows.columns))
        above = moved.select(F.col("conv_id").alias("of"), F.col("depth").alias("above"), F.col("k3").alias("above_k3"))
        rows = checkpoint(moved.drop("p3").join(above, (F.col("conv_id") == F.col("of")) & (F.col("up") == F.col("above")), "left").withColumn("p3", F.coalesce("above_k3", F.lit(0))).select(*rows.columns))
        groups = checkpoint(_groups(rows))
    return rows, groups


def _sums(rows: DataFrame, block: int) -> DataFrame:
    """n_leaves and saved_tokens by key; rows(conv_id, depth, length, key, rep, n_convs, n_ends, node_chars)."""
    owned = F.col("rep") == F.col("conv_id")
    saved = F.when(owned, (F.col("n_convs") - 1) * F.col("node_chars")).otherwise(F.lit(0))
    leaf = F.when(owned & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0)
    place = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / block)
    weighed = rows.select("conv_id", "length", *_KEY, place.alias("place"), saved.alias("saved"), leaf.alias("leaf"))
    after = Window.partitionBy("conv_id", "place").orderBy(F.desc("depth"))
    summed = weighed.select("conv_id", "length", "place", *_KEY, F.sum("saved").over(after).alias("saved"), F.sum("leaf").over(after).alias("leaves"))
    short, long = summed.where(F.col("length") <= block), summed.where(F.col("length") > block)
    later = Window.partitionBy("conv_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = weighed.where(F.col("length") > block).groupBy("conv_id", "place").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    blocks = blocks.select(F.col("conv_id").alias("of"), F.col("place").alias("in_place"), *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("saved", "leaf")])
    long = long.join(blocks, (F.col("conv_id") == F.col("of")) & (F.col("place") == F.col("in_place")))
    long = long.select("conv_id", "length", "place", *_KEY, (F.col("saved") + F.col("later_saved")).alias("saved"), (F.col("leaves") + F.col("later_leaf")).alias("leaves"))
    given = short.unionByName(long).where("saved > 0 or leaves > 0")
    return given.groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows by (key, conv_id): ids of a key as texts of a bounded size, with the first of each."""
    key, first, listed, size, done = None, 0, [], 0, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: pa.array(col, pa.string() if name == "listed" else pa.int64()) for name, col in zip([*_KEY, "first", "listed"], zip(*rows, strict=True), strict=True)})

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
            text = str(row[-1])
            if row[:-1] != key or size + len(text) >= piece_bytes:
                if key is not None:
                    done.append((*key, first, ",".join(listed)))
                key, first, listed, size = row[:-1], row[-1], [], 0
            listed.append(text)
            size += len(text) + 1
        if len(done) >= 1000 or sum(len(x[-1]) for x in done) >= piece_bytes:
            yield batch_of(done)
            done = []
    if key is not None:
        yield batch_of([*done, (*key, first, ",".join(listed))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (key, first): the SHA-256 of each key's pieces, joined by commas."""
    key, held = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "listed")), strict=True):
            if row[:-1] == key:
                held.update(b"," + row[-1].encode())
                continue
            if key is not None:
                done.append((*key, held.hexdigest()))
            key, held = row[:-1], hashlib.sha256(row[-1].encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip([*_KEY, "ends_sha256"], map(list, zip(*done, strict=True)), strict=True)))
    if key is not None:
        yield pa.RecordBatch.from_pydict(dict(zip([*_KEY, "ends_sha256"], ([x] for x in (*key, held.hexdigest())), strict=True)))


def _endings(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """ends_sha256 by key, of nodes at which conversations end."""
    ends = checkpoint(rows.where("depth = length").select(*_KEY, "conv_id"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(parts, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    keys = "depth long, k1 long, k2 long, k3 long"
    pieces = ranged.mapInArrow(lambda batches: _pieces(batches, piece_bytes), f"{keys}, first long, listed string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, f"{keys}, ends_sha256 string")


def trie(conversations: DataFrame, other: Column, borrowed: Column, block: int = BLOCK, bits: int = 64, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is rebuilt from the first `borrowed` turns of the conversation `other`
    and its own turns after as many; both are columns over conv_id.  Turns ascend by turn,
    nulls first; turns that share a number by the digest of role and text, and equal rows
    each are turns.  Null roles and texts are empty ones.  Rows with a null conv_id are left out.  A
    conversation of which nothing is left still is a member of the root.  Turns are equal if
    their SHA-256 digests are.  Other columns are not read.  Without conversations there is no node.

    `bits` of each fingerprint lane are kept; fewer only make more groups that are split.
    """
    turns, convs = _rebuilt(conversations, other, borrowed)
    rows = checkpoint(_prefixes(turns, convs, block, bits))
    rows, groups = _split(rows, checkpoint(_groups(rows)))
    met = join_hot(rows.select("conv_id", "depth", "length", "k1", "k2", "k3"), groups.select(*_KEY, "rep", "n_convs", "n_ends", "node_chars"), _KEY, "n_convs")
    sums = _sums(met, block)
    children = groups.where("depth > 0").groupBy(*_UP).agg(F.count("*").alias("n_children"))

    def beside(nodes: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
        named = more.withColumnsRenamed({c: f"of_{c}" for c in keys})
        return nodes.join(named, [F.col(c) == F.col(f"of_{k}") for c, k in zip(_KEY, keys, strict=True)], "left").drop(*[f"of_{c}" for c in keys])

    nodes = beside(beside(beside(groups, sums, _KEY), children, _UP), _endings(rows, piece_bytes), _KEY)
    nodes = checkpoint(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("k3").alias("p3"), F.col("rep").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    found = join_hot(nodes.withColumnRenamed("n_children", "children"), parents, _UP, "weight", "left")
    return found.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        "n_leaves",
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
