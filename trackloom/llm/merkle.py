"""A Merkle manifest of a dataset, with a proof for every row by lookups of coordinates.

1. Every row becomes a leaf digest; texts are read once and go no further.
2. Leaves are placed by source and id in ranges, so that a source may hold any share of
   the rows.  Each source is a tree; runs of `FAN` consecutive nodes become one node of
   the next level, down to a subroot; the subroots are the leaves of one tree above.
3. A node at place `at` of a level of n nodes needs the coordinates
   `at - at % FAN .. min(.. + FAN - 1, n - 1)` without its own.  They are exploded, joined
   to the materialised nodes, ordered and concatenated.  A node's siblings are looked up
   once, not again for each leaf below it: what a node's proof needs above it is handed
   down from its parent, of which at most `FAN` nodes read.
4. A leaf's proof is hashed, and folded with its digest up to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .ordering import groups_of, placed, ranked

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST_CHARS = 64


def lower_cased(text: Column) -> Column:
    """text with A-Z, and only these, in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def leaf_digest(fields: list[Column]) -> Column:
    """The packed digest of fields, each `-` if null, else its bytes in UTF-8, a colon and its value."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(nodes: Column) -> Column:
    """Digests of structs (place, digest) as one text, by place."""
    return F.array_join(F.transform(F.sort_array(nodes), lambda x: _hex(x["digest"])), "")


def _levels(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """nodes(tree, at, n, digest) and the levels above them, up to one node a tree; `most`: n of the largest tree."""
    levels = [nodes]
    while most > 1:
        run = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("at") / fan).alias("at"), F.ceil(F.col("n") / fan).alias("n"))
        above = run.agg(F.sha2(_joined(F.collect_list(F.struct(F.col("at").alias("place"), "digest"))), 256).alias("digest"))
        levels.append(checkpoint(above.withColumn("digest", F.unhex("digest"))))
        most = -(-most // fan)
    return levels


def _siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """tree, own (place), others: the digests of the other nodes of each node's run, left to right; a node alone has no row."""
    first = F.col("at") - F.col("at") % fan
    run = F.sequence(first, F.least(first + (fan - 1), F.col("n") - 1))
    wanted = nodes.where("n > 1").select(F.col("tree").alias("in_tree"), F.col("at").alias("own"), F.explode(F.filter(run, lambda x: x != F.col("at"))).alias("wanted"))
    found = wanted.join(nodes.select("tree", "at", "digest"), (F.col("in_tree") == F.col("tree")) & (F.col("wanted") == F.col("at")))
    return found.groupBy("in_tree", "own").agg(_joined(F.collect_list(F.struct(F.col("wanted").alias("place"), "digest"))).alias("others"))


def _paths(levels: list[DataFrame], tops: DataFrame | None, fan: int) -> DataFrame:
    """The rows of the lowest level with `steps`, an array of (pos, others) up to the root, and `subroot`.

    tops(of, top_steps): for each tree, the steps of its top node; None: there are none.
    """
    paths = None
    for nodes in reversed(levels):
        top = nodes.where("n = 1")
        if tops is None:
            top = top.withColumn("top_steps", F.array().cast("array<struct<pos:int,others:string>>"))
        else:
            top = top.join(tops, F.col("tree") == F.col("of"))
        top = top.select(*nodes.columns, F.col("top_steps").alias("steps"), _hex(F.col("digest")).alias("subroot"))
        if paths is not None:
            up = paths.select(F.col("tree").alias("up_tree"), F.col("at").alias("up_at"), F.col("steps").alias("up_steps"), "subroot")
            others = F.coalesce("others", F.lit(""))
            step = F.array(F.struct((F.col("at") % fan).cast("int").alias("pos"), others.alias("others")))
            low = nodes.where("n > 1").join(_siblings(nodes, fan), (F.col("tree") == F.col("in_tree")) & (F.col("at") == F.col("own")), "left")
            low = low.join(up, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("at") / fan) == F.col("up_at")))
            top = top.unionByName(low.select(*nodes.columns, F.concat(step, "up_steps").alias("steps"), "subroot"))
        paths = top if nodes is levels[0] else checkpoint(top)
    return paths


def _folded(digest: Column, steps: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    put = lambda h, s: F.concat(F.substr(s["others"], F.lit(1), s["pos"] * _DIGEST_CHARS), h, F.substr(s["others"], s["pos"] * _DIGEST_CHARS + 1))
    return F.aggregate(steps, digest, lambda h, s: F.sha2(put(h, s), 256))


def prove(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Digests are SHA-256 in lower-case hex.  Leaves of a source ascend by doc_id, null ids
    first, and rows that share an id by their leaf digest; equal rows are leaves of their
    own.  Null is a source like others, and comes first.  Null fields count as `-`, empty
    texts as `0:`.  Where `tampered` holds, the folded root starts from a leaf with
    `tampered_text` in place of the text; null there is false.  Columns beside the five
    fields are not read.  Without rows there is no root, and the result is empty.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(tampered, leaf_digest([*fields[:-1], tampered_text])) if tampered is not None else F.lit(None).cast("binary")
    leaves = checkpoint(docs.select("doc_id", "source", leaf_digest(fields).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("row")))
    leaves = placed(leaves, ["source", "doc_id", "digest", "row"])
    groups = checkpoint(groups_of(leaves, "source"))
    sources = checkpoint(ranked(groups, "source"))
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()

    known = groups.join(sources.select(F.col("source").alias("of_source"), F.col("rank").alias("tree")), F.col("source").eqNullSafe(F.col("of_source")))
    known = known.select(F.col("part").alias("in_part"), F.col("source").alias("in_source"), "first", "before", F.col("total").alias("n"), "tree")
    same = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("in_source"))
    nodes = checkpoint(leaves.join(known, same).select("tree", (F.col("spot") - F.col("first") + F.col("before")).alias("at"), "n", "digest", "doc_id", "changed"))
    levels = _levels(nodes, most, fan)
    subroots = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    above = checkpoint(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_sources).cast("long").alias("n"), "digest"))
    upper = _levels(above, n_sources, fan)
    root = upper[-1].select(_hex(F.col("digest"))).first()  # one digest
    tops = checkpoint(_paths(upper, None, fan).select(F.col("at").alias("of"), F.col("steps").alias("top_steps")))
    paths = _paths(levels, tops, fan)
    folded = _folded(_hex(F.coalesce("changed", "digest")), F.col("steps"))
    out = paths.select(
        "doc_id",
        _hex(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("steps", lambda s: s["others"]), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
