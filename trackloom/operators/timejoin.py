"""Joins by time with bins that are made from the data.

Time is cut into bins of one width, and rows meet by key and bin, so the rows that a
row is compared with do not grow with its key.  The width is the length that nine of ten
ranges do not exceed, but so large that no range covers more than `MOST_BINS` bins.  A
point lies in one bin, hence outer, semi and anti joins need nothing more.  Bins with more
than a thousandth of all points, fewer than a thousand, are counted, broadcast and split:
their points are dealt into parts, and their ranges come to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BINS, USUAL, SHARE = 64, 0.9, 1000
#: Points of a bin from which on it may be split.
LARGE_BIN = 10_000


def width_of(ranges: DataFrame, margin: float = 0.0) -> float:
    """The width of bins for ranges(start, end); two numbers from one pass."""
    length = F.col("end") - F.col("start") + 2 * margin
    usual, longest = ranges.where(F.col("end") >= F.col("start")).agg(F.percentile_approx(length, USUAL), F.max(length)).first()
    return max(usual or 0.0, (longest or 0.0) / MOST_BINS) or 1.0


def _bins(start: Column, end: Column, width: float) -> Column:
    low = F.floor(start / width)
    return F.explode(F.sequence(low, F.greatest(low, F.floor(end / width))))


def hot_bins(binned: DataFrame, key: str, large: int = LARGE_BIN) -> DataFrame:
    """hot_key, hot_bin, parts of bins that hold more than a thousandth of all rows, and more than `large`."""
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(large, total // SHARE)
    return counts.where(F.col("n") > most).select(F.col(key).alias("hot_key"), F.col("bin").alias("hot_bin"), F.ceil(F.col("n") / most).cast("int").alias("parts"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: str, t: str = "t", margin: float = 0.0, how: str = "inner", width: float | None = None, large: int = LARGE_BIN) -> DataFrame:
    """points with the ranges(key, start, end, ...) that hold their time, both ends included.

    how: inner, left, left_semi or left_anti.  ranges should be settled, as they are read
    for the width and again for the join.  Null keys and times meet nothing; a range that ends before it
    starts holds nothing; equal rows each count.
    """
    width = width or width_of(ranges, margin)
    p = points.withColumn("bin", F.floor(F.col(t) / width))
    r = ranges.select(*[F.col(c).alias(f"r_{c}") for c in ranges.columns])
    r = r.where("r_start <= r_end").withColumn("r_bin", _bins(F.col("r_start") - margin, F.col("r_end") + margin, width))
    hot = F.broadcast(hot_bins(p.select(key, "bin"), key, large))
    p = p.join(hot, (F.col(key) == F.col("hot_key")) & (F.col("bin") == F.col("hot_bin")), "left").withColumn("part", F.pmod(F.xxhash64(t, *[c for c in points.columns if c != t][:4]), F.coalesce("parts", F.lit(1)))).drop("hot_key", "hot_bin", "parts")
    r = r.join(hot, (F.col(f"r_{key}") == F.col("hot_key")) & (F.col("r_bin") == F.col("hot_bin")), "left")
    r = r.withColumn("r_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("hot_key", "hot_bin", "parts")
    same = (F.col(key) == F.col(f"r_{key}")) & (F.col("bin") == F.col("r_bin")) & (F.col("part") == F.col("r_part"))
    within = (F.col(t) >= F.col("r_start") - margin) & (F.col(t) <= F.col("r_end") + margin)
    joined = p.join(r, same & within, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*points.columns)
    return joined.select(*points.columns, *[F.col(f"r_{c}").alias(c) for c in ranges.columns if c != key])


def overlapping(left: DataFrame, right: DataFrame, key: str, closed: bool = False, width: float | None = None) -> DataFrame:
    """Pairs of rows of one key whose (start, end) overlap; columns of the right get the prefix `r_`.

    closed: touching ends count.  A pair meets in the bin in which the later of its starts lies, and there only.
    """
    width = width or max(width_of(left), width_of(right))
    a = left.withColumn("bin", _bins(F.col("start"), F.col("end"), width))
    b = right.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    b = b.withColumn("r_bin", _bins(F.col("r_start"), F.col("r_end"), width))
    test = (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")) if closed else (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    once = F.col("bin") == F.floor(F.greatest("start", "r_start") / width)
    return a.join(b, (F.col(key) == F.col("r_key")) & (F.col("bin") == F.col("r_bin")) & test & once).drop("bin", "r_bin", "r_key")
