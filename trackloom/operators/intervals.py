"""Segments from activity, and joins by time.

Every join by time has an equality on the key of the stream, so it is hash
partitioned; where one key may hold very many rows, time is cut into bins and the
bin joins the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import interval_iou
from . import timejoin
from .config import Config
from .settled import settled


def islands(frames: DataFrame, key: str = "video_id", t: str = "t", active: str = "is_active", duration: DataFrame | float | None = None) -> DataFrame:
    """(key, start, end) of runs of active rows; a run ends at the first inactive row after it.

    duration, one for all or a table (key, duration), closes a run that is open at
    the end, else its last active row does.  Ties in time are in no order, so times should be distinct.
    """
    w = Window.partitionBy(key).orderBy(t)
    before = F.coalesce(F.lag(active).over(w), F.lit(False))
    marked = frames.withColumn("run", F.sum((F.col(active) & ~before).cast("int")).over(w)).withColumn("after", F.lead(t).over(w))
    runs = marked.where(F.col(active)).groupBy(key, "run").agg(F.min(t).alias("start"), F.max_by("after", t).alias("closed"), F.max(t).alias("last"))
    if isinstance(duration, DataFrame):
        runs = runs.join(duration, key, "left").withColumn("last", F.coalesce("duration", "last"))
    elif duration is not None:
        runs = runs.withColumn("last", F.lit(float(duration)))
    return runs.select(key, "start", F.coalesce("closed", "last").alias("end"))


def pad(segments: DataFrame, config: Config = Config()) -> DataFrame:
    """Earlier starts and later ends; a short segment gets less before it; no start below 0."""
    pre = F.when(F.col("end") - F.col("start") < config.short_sec, min(config.preroll, config.short_preroll)).otherwise(config.preroll)
    return segments.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - pre), "end": F.col("end") + config.postroll})


def clip(segments: DataFrame, duration: Column) -> DataFrame:
    """Within 0 and the duration; what is left empty goes."""
    cut = segments.withColumns({"start": F.greatest(F.lit(0.0), F.col("start")), "end": F.least(duration, F.col("end"))})
    return cut.where("end > start")


def merge(segments: DataFrame, key: str = "video_id", gap: float = 0.0) -> DataFrame:
    """(key, start, end): segments joined where the gap to all before is at most `gap`."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start") - reach > gap) | reach.isNull()
    return segments.withColumn("island", F.sum(fresh.cast("int")).over(w)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def build(frames: DataFrame, key: str = "video_id", duration: DataFrame | float | None = None, config: Config = Config()) -> DataFrame:
    """(key, seg_idx, start, end): runs, padded, clipped, merged, without the short ones."""
    found = pad(islands(frames, key, duration=duration), config)
    if isinstance(duration, DataFrame):
        found = clip(found.join(duration, key), F.col("duration")).drop("duration")
    elif duration is not None:
        found = clip(found, F.lit(float(duration)))
    long = merge(found, key, config.merge_gap).where(F.col("end") - F.col("start") >= config.min_length)
    return long.withColumn("seg_idx", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).select(key, "seg_idx", "start", "end")


def in_range(points: DataFrame, ranges: DataFrame, key: str, t: str = "t", bin_width: float | None = None, margin: float = 0.0, how: str = "inner") -> DataFrame:
    """points with the ranges(key, start, end, ...) that hold their time, both ends included, by bins of time.

    bin_width: else it is made from the ranges' lengths.  how: inner, left, left_semi or left_anti.
    """
    return timejoin.points_in_ranges(points, ranges if bin_width else settled(ranges), key, t, margin, how, bin_width)


def overlapping(left: DataFrame, right: DataFrame, key: str, closed: bool = False, width: float | None = None) -> DataFrame:
    """Pairs of rows of one key whose (start, end) overlap, by bins of time; columns of the right get the prefix `r_`.

    closed: touching ends count.
    """
    if width is None:
        left, right = settled(left), settled(right)
    return timejoin.overlapping(left, right, key, closed, width)


def as_of(probes: DataFrame, rows: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """probes with `value` of the latest row at or before each time; one sort by (key, time), no pairs."""
    tagged = probes.withColumn("is_probe", F.lit(1)).unionByName(rows.select(key, t, F.col(value).alias("as_of"), F.lit(0).alias("is_probe")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("as_of", F.last("as_of", ignorenulls=True).over(w)).where("is_probe = 1").drop("is_probe").withColumnRenamed("as_of", value)


def first_within(probes: DataFrame, rows: DataFrame, key: str, t: str, order: str, tolerance: float, probe_id: str) -> DataFrame:
    """Each probe with the first row in `order`, not the nearest, whose time differs by less than the tolerance."""
    right = rows.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != key]).withColumn("bin", F.floor(F.col(f"r_{t}") / tolerance))
    left = probes.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(t) / tolerance) + k)))
    near = left.join(right, (left[key] == right["r_key"]) & (left["bin"] == right["bin"]) & (F.abs(F.col(t) - F.col(f"r_{t}")) < tolerance)).drop("bin", "r_key")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(probe_id).orderBy(f"r_{order}"))).where("place = 1").drop("place")


def nearest_within(probes: DataFrame, rows: DataFrame, key: str, t: str, order: str, tolerance: float, probe_id: str) -> DataFrame:
    """Each probe with the row nearest in time within the tolerance, both ends included; ties by `order`."""
    right = rows.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != key]).withColumn("bin", F.floor(F.col(f"r_{t}") / tolerance))
    left = probes.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(t) / tolerance) + k)))
    gap = F.abs(F.col(t) - F.col(f"r_{t}"))
    near = left.join(right, (left[key] == right["r_key"]) & (left["bin"] == right["bin"]) & (gap <= tolerance)).drop("bin", "r_key")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(probe_id).orderBy(gap, f"r_{order}"))).where("place = 1").drop("place")


def iou_pairs(predicted: DataFrame, truth: DataFrame, key: str = "video_id", least: float = 0.5) -> DataFrame:
    """(key, p_idx, t_idx, iou, ...) of overlapping segments whose IoU reaches `least`."""
    p = predicted.select(key, F.col("seg_idx").alias("p_idx"), "start", "end")
    t = truth.select(key, F.col("seg_idx").alias("t_idx"), "start", "end")
    pairs = overlapping(p, t, key).withColumnRenamed("r_t_idx", "t_idx")
    return pairs.withColumn("iou", interval_iou(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).where(F.col("iou") >= least)


def trail(points: DataFrame, probes: DataFrame, key: str, probe_id: str, history: float, n: int, ahead: float = 0.1) -> DataFrame:
    """For each probe(probe_id, key, at): the last n points of each track in [at - history, at + ahead].

    points(key, track_id, t, ...): tracks are told apart by track_id.
    """
    p = probes.select(key, probe_id, "at", (F.col("at") - history).alias("start"), (F.col("at") + ahead).alias("end"))
    near = timejoin.points_in_ranges(points, p, key, width=history + ahead).drop("start", "end")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(probe_id, "track_id").orderBy(F.desc("t")))).where(F.col("place") <= n)


def window_with_straddling(points: DataFrame, probes: DataFrame, key: str, probe_id: str, span: float) -> DataFrame:
    """points(key, t, ...) from `span` before each of probes(probe_id, key, at) up to it, and the one that is under way as that begins."""
    began = probes.withColumn("t", F.col("at") - span)
    since = as_of(began, points.withColumn("since", F.col("t")), key, "t", "since")
    p = since.select(F.col(key).alias("p_key"), probe_id, "at", F.coalesce("since", F.col("at") - span).alias("since"))
    return points.join(p, (F.col(key) == F.col("p_key")) & (F.col("t") >= F.col("since")) & (F.col("t") <= F.col("at"))).drop("p_key")
