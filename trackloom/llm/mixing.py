"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source has a target of words.  A document of it takes `target / size of the
source` copies in the mean: the whole part is certain, and the rest is dealt out as
inclusion probabilities p of one copy more, in proportion to the documents' weights.
Documents are ranked by Pareto keys, u / (1 - u) divided by p / (1 - p) with u from a
hash of the row and a seed, and the first in that order are taken until the words that
the target still lacks are reached.

A source may hold most rows, so no source is ranked in one task: its keys are cut
into about sqrt(rows) ranges, the words of the ranges are summed up, and only the
one range in which the target falls is ranked.  What comes out is one key a source, up
to which documents are taken: each row is then decided where it is, and no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Weights of the sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_COPIES, SEED = 1.5, 2, 17


def word_count(text: Column) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_weight() -> Column:
    """Weights that grow with the logarithm of a document's words: longer documents are likelier, not in proportion."""
    return F.log1p(word_count(F.col("text")).cast("double"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, rows, source_size, target: share of all words dealt by weight, none above `most` times its source.

    The level that a weight of one gets, once sources at their limit are set
    apart, is found by going through the sources by limit for their weight.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by = by.withColumn("place", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    by = by.withColumn("limit", F.col("source_size").cast("double") * most).withColumn("level", F.col("limit") / F.col("weight"))
    rising = Window.orderBy("level", "place")
    full = Window.partitionBy()
    by = by.withColumn("before", F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open_weight", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("given", (F.sum("source_size").over(full) * share - F.col("before")) / F.col("open_weight"))
    by = by.withColumn("own", F.min(F.when(F.col("given") <= F.col("level"), F.struct("level", "place", "given"))).over(full)["given"])
    target = F.when(F.col("own").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("own") * F.col("weight")))
    return by.select("source", "rows", "source_size", target.alias("target"))


#: Sources up to this many are broadcast to the documents; more are joined by key.
BROADCAST_SOURCES = 20_000


def _by_source(rows: DataFrame, by: DataFrame, name: str = "of") -> DataFrame:
    """rows(source, ...) with the row of their source, or nulls; `by` is small unless there are very many sources."""
    side = F.broadcast(by) if by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else by
    return rows.join(side, F.col("source").eqNullSafe(F.col(name)), "left")


def _measured(rows: DataFrame, seed: int, weight: Column | str | None) -> DataFrame:
    """rows(doc_id, text, source, ...) with size, u and w."""
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce((F.col(weight) if isinstance(weight, str) else weight).cast("double"), F.lit(1.0)), F.lit(1e-9))
    # The 53 high bits of a hash, moved off 0 and 1.  It takes in the text, so that rows which share an id differ.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return rows.withColumns({"size": word_count(F.col("text")), "u": u, "w": own})


def _keyed(measured: DataFrame, by: DataFrame) -> DataFrame:
    """measured rows with their source's row of `by`, and the Pareto key and its range."""
    p = F.least(F.greatest(F.col("part") * F.col("w") / F.greatest(F.col("mean_w"), F.lit(1e-9)), F.lit(1e-12)), F.lit(1 - 1e-12))
    key = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return _by_source(measured, by).withColumn("key", key).withColumn("range", F.floor(F.col("key") / (1 + F.col("key")) * F.col("ranges")).cast("long"))


def _plan(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """One row per source of sizes(source, size, u, w): its target, and the keys up to which documents are taken.

    edge_range: the range in which the target falls; cut: the last (key, u) taken
    in it; extra: one more, which rounds the words off.
    """
    by = targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    mean = sizes.groupBy(F.col("source").alias("w_of")).agg((F.sum(F.col("w") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))).alias("mean_w"))
    by = by.join(mean, F.col("of").eqNullSafe(F.col("w_of")), "left").drop("w_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A rate a hair below a whole number, from rounding, is that number.
    by = by.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long"))
    by = by.withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).withColumn("lacks", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    by = checkpoint(by.withColumn("ranges", F.ceil(F.sqrt(F.col("rows").cast("double"))).cast("long")))

    keyed = _keyed(sizes, by).where("lacks > 0 and size > 0")
    running = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("of", "range", "lacks").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("words_before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    # The range in which the target falls: before it all are taken, after it none.
    edge = ranges.where("words_before < lacks and words_before + words >= lacks").groupBy(F.col("of").alias("edge_of")).agg(F.min_by(F.struct("range", "words_before"), "range").alias("edge"))
    edge = checkpoint(edge.select("edge_of", F.col("edge.range").alias("edge_range"), F.col("edge.words_before").alias("edge_before")))
    inside = _by_source(keyed, edge, "edge_of").where("range = edge_range")
    # Equal rows have one key and are drawn together.
    inside = inside.groupBy("of", "edge_range", "edge_before", "lacks", F.struct("key", "u").alias("at")).agg(F.sum("size").alias("words"))
    rank = Window.partitionBy("of").orderBy("at")
    inside = inside.withColumn("upto", F.col("edge_before") + F.sum("words").over(rank.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("upto") <= F.col("lacks"))
    whole = Window.partitionBy("of")
    gap = F.col("lacks") - F.coalesce(F.max(F.when(F.col("first"), F.col("upto"))).over(whole), F.col("edge_before"))
    # One document more rounds the sum off: the one that leaves the least gap, if it leaves less.
    left = F.abs(F.col("gap") - F.col("words"))
    inside = inside.withColumn("gap", gap).withColumn("rounding", F.when(~F.col("first") & (left < F.col("gap")), F.struct(left.alias("left"), F.col("at"))))
    cuts = inside.groupBy(F.col("of").alias("cut_of"), "edge_range").agg(F.max(F.when(F.col("first"), F.col("at"))).alias("cut"), F.min("rounding")["at"].alias("extra"))
    return checkpoint(by.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"))


def _copies(most: int) -> Column:
    """Of a keyed row: how often it is taken."""
    at = F.struct("key", "u")
    edge = F.coalesce(at <= F.col("cut"), F.lit(False)) | F.coalesce(at == F.col("extra"), F.lit(False))
    before = F.col("edge_range").isNull() | (F.col("range") < F.col("edge_range"))
    more = (F.col("lacks") > 0) & (before | ((F.col("range") == F.col("edge_range")) & edge))
    return F.when(F.col("size") > 0, F.least(F.col("whole") + more.cast("long"), F.lit(most))).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED, weight: Column | str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size times copies) for each row of docs.

    weight: positive document weights, a column or an expression over docs; null or
    none counts as 1.  Null and empty texts have size 0 and are never taken.  A null
    source is a source of its own, the last.  Rows may share ids or have none; rows
    equal in id, text and source are drawn together.  An empty table gives an empty
    result.  A document's copies never exceed `most`.
    """
    sizes = checkpoint(_measured(docs, seed, weight).select("doc_id", "source", "size", "u", "w"))
    drawn = _keyed(sizes, _plan(sizes, weights, share, most)).withColumn("copies", _copies(most))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED, weight: Column | str | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it, rows with null or shared ids too; columns as in docs.

    Rows are decided where they are, by what is known of their source.
    """
    own = ("doc_id", "text", "source")
    # All columns travel in one, so that none clashes with those made here.
    packed = docs.select(*own, F.struct("*").alias("row"), *([weight] if isinstance(weight, str) and weight not in own else []))
    measured = _measured(packed, seed, weight)
    sizes = checkpoint(measured.select("source", "size", "u", "w"))
    drawn = _keyed(measured, _plan(sizes, weights, share, most)).withColumn("copies", _copies(most)).where("copies > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select("row.*")
