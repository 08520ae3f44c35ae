"""Aggregates over frames, tracks, segments and library usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import intervals, timejoin
from .config import Config
from .settled import settled


def histogram(confidence: Column) -> list[Column]:
    """high from 0.8, medium from 0.5, low below."""
    return [F.count_if(confidence >= 0.8).alias("high"), F.count_if((confidence >= 0.5) & (confidence < 0.8)).alias("medium"), F.count_if(confidence < 0.5).alias("low")]


def frame_stats(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Counts of frames(key, processed, n_detections, n_tracks, is_active, is_valid, confidence) and their ratios, 0 without frames."""
    n = F.count("*")
    processed = F.count_if("processed")
    detected = F.count_if(F.col("n_detections") > 0)
    out = frames.groupBy(key).agg(
        n.alias("total_frames"),
        processed.alias("processed_frames"),
        detected.alias("detection_frames"),
        F.count_if(F.col("n_tracks") > 0).alias("tracking_frames"),
        F.count_if("is_active").alias("rally_frames"),
        F.count_if("is_valid").alias("physics_valid_frames"),
        F.coalesce(F.sum("n_detections"), F.lit(0)).alias("total_detections"),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("sum_confidence"),
    )
    c = lambda name: F.col(name).cast("double")
    return out.withColumns(
        {
            "completeness": N.ratio(c("processed_frames"), c("total_frames")),
            "detection_rate": N.ratio(c("detection_frames"), c("processed_frames")),
            "detections_per_frame": N.ratio(c("total_detections"), c("processed_frames")),
            # summed per track, divided by frames with detections
            "average_confidence": N.ratio(c("sum_confidence"), c("detection_frames")),
        }
    ).drop("sum_confidence")


def last_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The latest n rows of each key: what a bounded history still holds."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("place") <= n).drop("place")


def segment_metrics(segments: DataFrame, physics: DataFrame, trajectories: DataFrame, config: Config = Config(), limits: bool = True, key: str = "video_id", bin_width: float | None = None) -> DataFrame:
    """segments(key, seg_idx, start, end) with confidence, quality, detection_count and mean_trajectory_length.

    physics(key, t, is_valid, r2, confidence) within both ends; trajectories(key,
    start, end, n_points) that overlap strictly.  Each is 0 where nothing is there.
    limits: only as many latest rows count as the history holds.  Segments are found once, and rows meet
    them by bins of time whose width is made from their lengths, unless `bin_width` gives it.
    """
    if limits:
        physics = last_rows(physics, key, "t", config.max_validations)
        trajectories = last_rows(trajectories, key, "end", config.max_trajectories)
    confidence, quality = F.avg("confidence").alias("confidence"), F.avg(F.when(F.col("is_valid") & (F.col("r2") > 0), F.col("r2"))).alias("quality")
    zero = {"confidence": 0.0, "quality": 0.0, "detection_count": 0, "mean_trajectory_length": 0.0}
    segments = settled(segments)
    width = bin_width or timejoin.width_of(segments)
    rows = timejoin.points_in_ranges(physics, segments, key, width=width)
    p = rows.groupBy(key, "seg_idx").agg(confidence, quality, F.count("*").alias("detection_count"))
    over = timejoin.overlapping(segments, trajectories.select(key, "start", "end", "n_points"), key, width=width)
    t = over.groupBy(key, "seg_idx").agg(F.avg("r_n_points").alias("mean_trajectory_length"))
    return segments.join(p, [key, "seg_idx"], "left").join(t, [key, "seg_idx"], "left").fillna(zero)


def size_trend(points: DataFrame, segments: DataFrame, key: str = "video_id", first: int = 10) -> DataFrame:
    """Slope of the box area over the first points of each segment; null below three, or without a span of time."""
    own = intervals.in_range(points, segments, key)
    w = Window.partitionBy(key, "seg_idx").orderBy("t", "area")
    own = own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first).withColumn("dt", F.col("t") - F.min("t").over(Window.partitionBy(key, "seg_idx")))
    x, y = F.col("dt"), F.col("area")
    slope = N.line_slope(F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x))
    return own.groupBy(key, "seg_idx").agg(slope.alias("trend"))


def quality_rollup(rates: list[Column], r2: Column, confidence: Column) -> list[Column]:
    """The mean of the rates, the mean fit, and the mean confidence, which is null without rows."""
    return [F.avg(sum(rates[1:], rates[0]) / len(rates)).alias("overall_quality"), F.coalesce(F.avg(r2), F.lit(0.0)).alias("average_r2"), F.avg(confidence).alias("accuracy")]


def track_confidence(age: Column, net: Column, n_points: Column) -> Column:
    """From age and net displacement, within 0.1 and 0.95; 0.3 below two points."""
    part = (F.least(F.lit(1.0), age / 10.0) + F.least(F.lit(1.0), net * 5.0)) / 2
    return F.when(n_points < 2, F.lit(0.3)).otherwise(N.clamp(part, 0.1, 0.95))


def squared_correlation(x: str, y: str) -> Column:
    """Aggregate: squared Pearson correlation, 0 where either never changes."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), N.clamp(F.pow(F.covar_pop(x, y) / (sx * sy), F.lit(2)))).otherwise(F.lit(0.0))


def serve_signature(evidence: DataFrame, segments: DataFrame, window: float = 2.0, key: str = "video_id") -> DataFrame:
    """normalized_slope, monotonicity and n of the ball's size (column `size`) in the first `window` of each segment.

    Null below three sizes, without a span of time, or without a positive mean.
    """
    head = segments.withColumn("end", F.col("start") + window)
    own = intervals.in_range(evidence.where("size > 0"), head.select(key, "seg_idx", "start", "end"), key).withColumn("dt", F.col("t") - F.col("start"))
    w = Window.partitionBy(key, "seg_idx").orderBy("t", "size")
    own = own.withColumn("step", F.col("size") - F.lag("size").over(w))
    x, y = F.col("dt"), F.col("size")
    sums = own.groupBy(key, "seg_idx").agg(
        N.line_slope(F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x)).alias("slope"),
        F.avg("size").alias("mean"),
        F.count("*").alias("n"),
        F.count_if(F.col("step") > 0).alias("up"),
        F.count_if(F.col("step") < 0).alias("down"),
    )
    moved = (F.col("up") + F.col("down")).cast("double")
    mono = N.ratio(F.when(F.col("slope") > 0, F.col("up")).otherwise(F.col("down")).cast("double"), moved)
    usable = F.col("slope").isNotNull() & (F.col("mean") > 1e-9)
    return sums.select(key, "seg_idx", F.when(usable, F.col("slope") / F.col("mean")).alias("normalized_slope"), F.when(usable, mono).alias("monotonicity"), "n")


#: Fixed weights and references of the segment score.
SCORE_WEIGHTS = {"serve": 0.40, "travel": 0.25, "continuity": 0.20, "size_dynamics": 0.15}
TRAVEL_REFERENCE, SLOPE_REFERENCE, SKY_Y = 0.35, 0.5, 0.85


def segment_score(evidence: DataFrame, segments: DataFrame, window: float = 2.0, key: str = "video_id") -> DataFrame:
    """serve, travel, continuity, size_dynamics, skyball, total and each part's share of it, per segment with frames.

    evidence(key, t, has_ball, size, sel_x, sel_y, track_y): sel_* is the chosen
    track's point, size the ball's side length, null where there is none.
    """
    own = intervals.in_range(evidence, segments, key)
    sky = F.max((F.col("t") <= F.col("start") + window) & (F.coalesce("track_y", F.lit(0.0)) >= SKY_Y))
    seen = F.count(F.col("sel_x"))
    spread = F.hypot(F.max("sel_x") - F.min("sel_x"), F.max("sel_y") - F.min("sel_y"))
    sizes = F.array_sort(F.collect_list(F.when(F.col("sel_x").isNotNull(), F.col("size"))))
    parts = own.groupBy(key, "seg_idx").agg(
        F.avg(F.col("has_ball").cast("double")).alias("continuity"),
        F.when(seen >= 2, F.least(F.lit(1.0), spread / TRAVEL_REFERENCE)).otherwise(F.lit(0.0)).alias("travel"),
        sizes.alias("sizes"),
        sky.alias("skyball"),
    )
    parts = parts.withColumn("size_dynamics", N.size_dynamics(F.col("sizes"))).drop("sizes")
    sig = serve_signature(evidence, segments, window, key)
    serve = F.coalesce(F.least(F.lit(1.0), F.abs("normalized_slope") / SLOPE_REFERENCE) * F.col("monotonicity"), F.lit(0.0))
    full = parts.join(sig, [key, "seg_idx"], "left").withColumn("serve", serve).drop("normalized_slope", "monotonicity", "n")
    weights = {k: F.when(F.col("skyball"), 0.0).otherwise(w) if k == "serve" else F.lit(w) for k, w in SCORE_WEIGHTS.items()}
    whole = sum(weights.values(), F.lit(0.0))
    shares = {f"{k}_share": N.ratio(F.col(k) * w, whole) for k, w in weights.items()}
    return full.withColumns(shares).withColumn("total", sum((F.col(k) for k in shares), F.lit(0.0)))


def ema(samples: DataFrame, key: str, order: str, x: str, alpha: float = 0.35, default: float = 0.65) -> DataFrame:
    """Moving average of x in `order`, seeded by the first; the default without samples is the caller's.

    In a closed form over positions, so it is a window and a sum, not a loop: the k-th
    of n samples weighs alpha (1 - alpha)^(n - k), the first (1 - alpha)^(n - 1).
    """
    w = Window.partitionBy(key)
    numbered = samples.withColumn("k", F.row_number().over(w.orderBy(order))).withColumn("n", F.count("*").over(w))
    weight = F.when(F.col("k") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), (F.col("n") - F.col("k")).cast("double"))
    return numbered.groupBy(key).agg(F.coalesce(F.sum(F.col(x) * weight), F.lit(default)).alias("ema"))


def lifetime(rows: DataFrame, key: str, item: str, order: str, value: str) -> DataFrame:
    """Per key: each item once, the first in `order`, and the sum of their values, none below 0."""
    first = rows.groupBy(key, item).agg(F.min_by(value, order).alias("v"))
    return first.groupBy(key).agg(F.count("*").alias("items"), F.sum(F.greatest(F.lit(0.0), F.col("v").cast("double"))).alias("total"))


def week_usage(rows: DataFrame, key: str, ts: str, seconds: str, now: Column) -> DataFrame:
    """Minutes since Monday midnight, UTC."""
    return rows.where((F.col(ts) >= F.date_trunc("week", now)) & (F.col(ts) <= now)).groupBy(key).agg((F.sum(seconds) / 60).alias("minutes"))


def trailing_rate(rows: DataFrame, key: str, seconds: str, flag: str, span: float) -> DataFrame:
    """rows with `rate`: flagged rows per unit of time over the trailing span, its start included; whole ticks of 1/600."""
    w = Window.partitionBy(key).orderBy(F.round(F.col(seconds) * 600).cast("long")).rangeBetween(-round(span * 600), 0)
    return rows.withColumn("rate", F.count_if(F.col(flag)).over(w) / max(span, 0.001))


def runs(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Run lengths of a state: key, run, state, first and last in order, n."""
    w = Window.partitionBy(key).orderBy(order)
    change = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(order).over(w).isNull()
    return rows.withColumn("run", F.sum(change.cast("int")).over(w)).groupBy(key, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def append_offsets(parts: DataFrame, key: str, order: str) -> DataFrame:
    """Edit list: where each (start, end) begins in the joined output."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)))


def least_confident(segments: DataFrame, key: str = "video_id", most: float = 0.5, k: int = 2) -> DataFrame:
    """Per key the k segments of least confidence, none above `most`."""
    w = Window.partitionBy(key).orderBy("confidence", "seg_idx")
    return segments.where(F.col("confidence") <= most).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def session_summary(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Means over all rows, those with nulls included."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(c), F.lit(0.0)) / F.count("*")).alias(f"mean_{c}") for c in columns])


def upload_progress(rows: DataFrame, key: str) -> DataFrame:
    """Counts by status and the mean progress: 1 when complete, its share while uploading, else 0."""
    part = F.when(F.col("status") == "complete", 1.0).when(F.col("status") == "uploading", F.col("progress")).otherwise(0.0)
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(part).alias("progress"))


def recent_velocity(points: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per key the mean speed over the steps of the last n points; 0 below two."""
    last = last_rows(points, key, "t", n)
    w = Window.partitionBy(key).orderBy("t")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    took = F.col("t") - F.lag("t").over(w)
    moved = last.withColumn("v", F.when(took > 0, step / took))
    return moved.groupBy(key).agg((F.coalesce(F.sum("v"), F.lit(0.0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("velocity"))


def recent_area(points: DataFrame, key: str, n: int = 12) -> DataFrame:
    """points with `mean_area` of the last n rows up to each."""
    return points.withColumn("mean_area", F.avg(F.col("w") * F.col("h")).over(Window.partitionBy(key).orderBy("t").rowsBetween(1 - n, 0)))


def recent_accuracy(rows: DataFrame, ts: str, now: Column, span: float = 300.0) -> DataFrame:
    """Share of hits and mean latency over the last `span` seconds; nulls without rows."""
    return rows.where(F.col(ts) >= now - span).agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg("latency").alias("latency"))


def snapshot(rows: DataFrame, key: str, order: str, item: str, value: str) -> DataFrame:
    """Distinct items of the last 100 rows, mean of the last 10 values, and the last value that is not null."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    placed = rows.withColumn("place", F.row_number().over(w)).where("place <= 100")
    return placed.groupBy(key).agg(F.countDistinct(item).alias("items"), F.avg(F.when(F.col("place") <= 10, F.col(value))).alias("mean_last"), F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("last_value"))


def prefixed(rows: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """Rows per key whose name begins with the prefix."""
    return rows.groupBy(key).agg(F.count_if(F.startswith(F.col(name), F.lit(prefix))).alias("n"))


def around(rows: DataFrame, key: str, place: str, current: DataFrame, reach: int = 2) -> DataFrame:
    """rows within `reach` places of current(key, at)."""
    return rows.join(current, key).where(F.col(place).between(F.col("at") - reach, F.col("at") + reach)).drop("at")


def sample(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """About `rate` of the rows, drawn by their own values, so that a rerun draws the same; equal rows go together."""
    return rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and n, the number of their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def strip(evidence: DataFrame, key: str) -> DataFrame:
    """evidence(key, t, has_ball, is_projectile) with its colour, and how long until the next frame; 0 for the last."""
    colour = F.when(F.col("is_projectile"), "projectile").when(F.col("has_ball"), "vetoed").otherwise("none")
    after = F.lead("t").over(Window.partitionBy(key).orderBy("t"))
    return evidence.withColumns({"colour": colour, "width": F.coalesce(after, F.col("t")) - F.col("t")})


def variation(value: str, reference: float = 0.25) -> dict[str, Column]:
    """Aggregates over rows, which combine before a shuffle: `functions.numeric.cv_open`, `steadiness` and `size_dynamics` of a column, without an array of it."""
    v = F.col(value)
    positive = F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v)
    return {
        "open_cv": F.when(F.count(v) < 2, F.lit(0.0)).when(F.avg(v) > 0, F.stddev_pop(v) / F.avg(v)).otherwise(F.lit(1.0)),
        "steadiness": F.when(F.count(positive) >= 2, N.clamp(1 - F.stddev_pop(positive) / F.avg(positive))).otherwise(F.lit(0.0)),
        "dynamics": F.when((F.count(v) >= 3) & (F.avg(v) > 1e-9), F.least(F.lit(1.0), F.stddev_pop(v) / F.avg(v) / reference)).otherwise(F.lit(0.0)),
    }


def speed_variation(points: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, cv): variation of the speeds between points(key, t, x, y) that follow each other, at most 1, and 1 without a positive mean."""
    w = Window.partitionBy(key).orderBy("t")
    took = F.col("t") - F.lag("t").over(w)
    speed = F.when(took > 0, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / took)
    by = points.select(key, speed.alias("speed")).where("speed is not null").groupBy(key)
    return by.agg(F.when(F.avg("speed") > 0, F.least(F.lit(1.0), F.stddev_pop("speed") / F.avg("speed"))).otherwise(F.lit(1.0)).alias("cv"))
