"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

Each line gets a hash, and each pair of neighbouring lines a rolling hash.  A chunk
ends after a line whose rolling hash is larger than those of the lines before and
after it, so boundaries depend on nearby lines only and survive insertions and
deletions elsewhere; two boundaries never adjoin, so only the last chunk of a text
can have a single line.  Chunks of two lines or more that occur before, in a
document with a smaller id or earlier in the same one, are removed.

Chunks are grouped by digest, body hash and bytes; where chunks of one digest and hash
differ in any byte, nothing is removed.  All work on a text is linear in its lines, or a
sort of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rolling hash is (hash of the line before * BASE + hash of the line) modulo MODULUS.
BASE, MODULUS = 1_000_003, (1 << 31) - 1
#: Parts into which the occurrences of one chunk are dealt.
SALTS = 32


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _let(value: Column, f) -> Column:
    """f(value) with the value made once: an outer column in a lambda may be made anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_lines, `at` and `chunks`: array of (lines, digest, h, body); empty for null and empty texts.

    at: what tells the rows of one document from others: the id, or a hash of the text where it is null.
    """
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"))
    rolling = lambda hs: F.transform(hs, lambda h, i: F.when(i == 0, h).otherwise((F.get(hs, i - 1) * BASE + h) % MODULUS))
    ends = lambda rs: F.transform(rs, lambda r, i: F.get(rs, i + 1).isNull() | ((i > 0) & (r > F.get(rs, i - 1)) & (r > F.get(rs, i + 1))))
    # A mark before every line leaves two line feeds in a row free to end a chunk.
    mark = lambda x, end: F.concat(F.lit("|"), x, F.when(end, "\n\n").otherwise("\n"))
    marked = docs.select("doc_id", at.alias("at"), lines.alias("lines")).select("doc_id", "at", F.size("lines").alias("n_lines"), _let(F.col("lines"), lambda ls: F.zip_with(ls, _let(_let(F.transform(ls, line_hash), rolling), ends), mark)).alias("marked"))
    pieces = F.filter(F.split(F.array_join("marked", ""), "\n\n"), lambda c: c != "")
    bodies = marked.select("doc_id", "at", "n_lines", pieces.alias("pieces"))
    chunk = lambda c: F.struct((F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1).alias("lines"), F.substring(F.replace(c, F.lit("\n|"), F.lit("\n")), 2, 1 << 30).alias("body"))
    cut = bodies.select("doc_id", "at", "n_lines", F.transform("pieces", chunk).alias("bodies"))
    return cut.select("doc_id", "at", "n_lines", F.transform("bodies", lambda c: F.struct(c["lines"].alias("lines"), F.unhex(F.md5(c["body"])).alias("digest"), F.xxhash64(c["body"]).alias("h"), c["body"].alias("body"))).alias("chunks"))


def _occurrences(chunked: DataFrame) -> DataFrame:
    """One row per chunk of two lines or more."""
    return chunked.select("at", F.explode(F.filter("chunks", lambda c: c["lines"] >= 2)).alias("c")).select("at", "c.digest", "c.h", "c.body")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_chunks, n_removed (lines), text (the kept lines).

    Null and empty texts have no lines; other texts have one more than line feeds.
    Rows that share an id keep what they share, as none comes before the other;
    rows with null ids likewise, after all others.  Other columns are not read.
    """
    chunked = _chunks(docs)
    # Among rows without an id none comes before another, so their first is the kind alone.
    before = lambda at: F.struct(at["unnamed"].alias("unnamed"), F.when(~at["unnamed"], at["id"]).alias("id"))
    bodies = _occurrences(chunked).groupBy("digest", "h", "body").agg(F.count("*").alias("n"), F.min(before(F.col("at"))).alias("first"))
    repeated = bodies.groupBy("digest", "h").agg(F.count("*").alias("bodies"), F.sum("n").alias("n"), F.min("first").alias("first")).where("bodies = 1 and n > 1").select(F.col("digest").alias("known"), F.col("h").alias("known_h"), "first")
    # One chunk may come in a third of all documents: its occurrences are dealt out by salt too.
    spread = repeated.withColumn("salt_known", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    salted = _occurrences(chunked).select("at", "digest", "h", F.pmod(F.xxhash64("at"), F.lit(SALTS)).alias("salt"))
    later = salted.join(spread, (F.col("digest") == F.col("known")) & (F.col("h") == F.col("known_h")) & (F.col("salt") == F.col("salt_known"))).where(before(F.col("at")) > F.col("first"))
    gone = later.groupBy(F.col("at").alias("gone_at")).agg(F.collect_set(F.struct("digest", "h")).alias("gone"))
    joined = chunked.join(gone, F.col("at") == F.col("gone_at"), "left")
    # Sorted by chunk, then place, with 0 for those that a document before has: all but the first of a chunk go.
    own = F.transform("chunks", lambda c, i: F.struct(F.when(c["lines"] >= 2, c["digest"]).alias("digest"), c["h"].alias("h"), F.when(c["lines"] >= 2, F.lit(0)).otherwise(i + 1).alias("alone"), (i + 1).alias("place")))
    known = F.transform(F.coalesce("gone", F.array().cast("array<struct<digest:binary,h:bigint>>")), lambda g: F.struct(g["digest"].alias("digest"), g["h"].alias("h"), F.lit(0).alias("alone"), F.lit(0).alias("place")))
    again = lambda b, c: b["digest"].eqNullSafe(c["digest"]) & (b["h"] == c["h"]) & (b["alone"] == c["alone"])
    flags = lambda cs: F.transform(cs, lambda c, i: F.struct(c["place"].alias("place"), ((i > 0) & F.coalesce(again(F.get(cs, i - 1), c), F.lit(False))).alias("goes")))
    goes = _let(F.sort_array(F.concat(known, own)), lambda cs: F.sort_array(F.filter(flags(cs), lambda f: f["place"] > 0)))
    paired = joined.select("doc_id", "n_lines", F.size("chunks").alias("n_chunks"), F.zip_with("chunks", goes, lambda c, g: F.struct(c["lines"].alias("lines"), c["body"].alias("body"), g["goes"].alias("goes"))).alias("paired"))
    kept = paired.select("doc_id", "n_lines", "n_chunks", F.filter("paired", lambda c: ~c["goes"]).alias("kept"))
    n_kept = F.aggregate("kept", F.lit(0), lambda a, c: a + c["lines"])
    return kept.select("doc_id", "n_lines", "n_chunks", (F.col("n_lines") - n_kept).alias("n_removed"), F.array_join(F.transform("kept", lambda c: c["body"]), "\n").alias("text"))
