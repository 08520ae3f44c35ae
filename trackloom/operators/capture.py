"""Passive capture: the least certain segments of each video, staged with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, metrics

#: Fixed limits: segments of a video, their confidence, staged videos, and seconds of evidence around a segment.
PER_VIDEO, MOST_CONFIDENCE, STAGED, MARGIN = 2, 0.5, 50, 0.25


def capture(segments: DataFrame, evidence: DataFrame, staged: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """New rows (user_id, local_video_id, seq, reason, events) for what is staged, and the evidence of the chosen segments.

    staged(local_video_id): while it holds `STAGED` videos or more, only known videos
    add to it.  Of new videos the first by id fill what is left.
    """
    chosen = metrics.least_confident(segments, "video_id", MOST_CONFIDENCE, PER_VIDEO)
    known = staged.select(F.col("local_video_id").alias("video_id")).distinct().withColumn("known", F.lit(True))
    room = staged.select(F.greatest(F.lit(0), F.lit(STAGED) - F.countDistinct("local_video_id")).alias("room"))
    fresh = chosen.select("video_id").distinct().join(known, "video_id", "left_anti").orderBy("video_id").limit(STAGED)
    fresh = fresh.withColumn("n", F.row_number().over(Window.orderBy("video_id"))).join(F.broadcast(room), F.col("n") <= F.col("room")).select("video_id")
    kept = chosen.join(known.select("video_id").union(fresh), "video_id", "left_semi")
    event = F.to_json(F.struct("seg_idx", "confidence"))
    rows = kept.select(F.lit(user).alias("user_id"), F.col("video_id").alias("local_video_id"), F.col("place").cast("long").alias("seq"), F.lit("low_score").alias("reason"), F.array(event).alias("events"))
    return rows, intervals.in_range(evidence, kept.select("video_id", "start", "end"), "video_id", margin=MARGIN, how="left_semi")
