"""Kernels per video in a batch.

A video's rows lie in one task, sorted by time, and stream by: a task works on many videos
in step, by arrays, and on a long one portion after portion.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gate, lockstep, selection
from .config import Config
from .court import LOG, NET, ROWS, CourtConfig, logged, rallies_of
from .decider import decide
from .kernels import Tracker

__all__ = ["court_rallies", "decide", "gated", "select", "track"]

TRACK_POINTS = "video_id string, frame_idx long, t double, det_idx int, track_id long, age int, x double, y double, raw_x double, raw_y double, vx double, vy double, mean_area double, radius double"


def followed(tracker: Tracker, rows: pd.DataFrame, stride: bool = False) -> pd.DataFrame:
    """The points that a tracker makes of one video's rows, which come in order of t, frame_idx and det_idx.

    stride: after each frame the tracker says how many frames on it wants to be, and the first frame
    from there on is looked up; rows between are not touched.
    """
    columns = {c: rows[c].to_numpy() for c in ("video_id", "t", "frame_idx", "det_idx", "x", "y", "w", "h")}
    frame, t = columns["frame_idx"], columns["t"]
    starts = np.flatnonzero(np.append(True, (frame[1:] != frame[:-1]) | (t[1:] != t[:-1]))) if len(rows) else np.empty(0, np.int64)
    ends, reach = np.append(starts[1:], len(rows)), np.maximum.accumulate(frame[starts])
    made, k = [], 0
    while k < len(starts):
        a, b = starts[k], ends[k]
        boxes = [(x + w / 2, y + h / 2, w, h) for x, y, w, h in zip(*(columns[c][a:b].tolist() for c in "xywh"), strict=True)]
        now = float(t[a])
        joined = tracker.step(now, boxes)
        by_id = {track.id: track for track in tracker.tracks}
        for at, track_id in joined:
            track = by_id[track_id]
            made.append((columns["video_id"][a], frame[a], now, columns["det_idx"][a + at], track_id, track.age, track.x, track.y, *boxes[at][:2], track.vx, track.vy, track.mean_area(), track.radius()))
        k = max(k + 1, int(np.searchsorted(reach, frame[a] + tracker.stride(now)))) if stride else k + 1
    return pd.DataFrame(made, columns=[x.split()[0] for x in TRACK_POINTS.split(", ")])


def track(detections: DataFrame, config: Config = Config(), stride: bool = False) -> DataFrame:
    """Points of tracks, one per detection that joined or began one; x and y are filtered.

    stride: skip frames as the tracker advises, counted over frame_idx.
    """

    names = ["video_id", "t", "frame_idx", "det_idx"]
    rows = detections.withColumn("video_id", F.col("video_id").cast("string")).select(*names, *[F.col(c).cast("double").alias(c) for c in "xywh"])
    schema = lockstep.arrow_schema(TRACK_POINTS)
    dealt = rows.repartition("video_id").sortWithinPartitions(*[F.asc_nulls_last(c) for c in names])
    return dealt.mapInArrow(lambda batches: lockstep.tracked(batches, schema, config, stride), TRACK_POINTS)


def gated(track_points: DataFrame, config: Config = Config()) -> DataFrame:
    """Track points with the gate's verdict over each one's recent points."""
    return gate.validate_windows(track_points, config)


def select(points: DataFrame, frames: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per frame of frames(video_id, t): whether a fresh track is there, and the chosen one's verdict."""
    key = [F.col("video_id").cast("string").alias("video_id"), F.col("t").cast("double").alias("t")]
    kinds = {"track_id": "long", "is_valid": "boolean", "age": "int"} | dict.fromkeys(selection.TRAITS, "double")
    latest = frames.select(*key).distinct().select("video_id", "t", F.lit(True).alias("is_frame"), *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    fresh = points.where("video_id is not null and t is not null").select(*key, F.lit(False).alias("is_frame"), *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    dealt = latest.unionByName(fresh).repartition("video_id").sortWithinPartitions("video_id", F.asc_nulls_last("t"), "is_frame", "track_id")
    return dealt.mapInArrow(lambda batches: selection.chosen(batches, config), selection.EVIDENCE)


RALLIES = "video_id string, rally_id int, start_frame long, end_frame long, start_time double, end_time double, net_crossings int, side_changes int, lost_events int, confidence int, end_reason string"
STATES = "video_id string, frame_idx long, t double, state string, ball_x double, ball_y double"


def court_rallies(detections: DataFrame, nets: DataFrame, config: CourtConfig = CourtConfig(), states: bool = False) -> DataFrame:
    """Rallies, or the state of each frame, from detections and nets(video_id, net_x, net_y, net_w, net_h).

    A frame without a ball has one row whose x is null.
    """
    names = ["video_id", "t", "frame_idx", "x", "y", "w", "h", "conf", *NET]
    joined = detections.join(nets, "video_id").withColumn("video_id", F.col("video_id").cast("string"))
    dealt = joined.withColumns({c: F.col(c).cast("double") for c in names[3:]}).select(*names, "det_idx").repartition("video_id").sortWithinPartitions("video_id", F.asc_nulls_last("t"), "frame_idx", "det_idx")

    def rows(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from zip(table.column("video_id").to_pylist(), *(lockstep.numbers(table, c).tolist() for c in names[1:]), strict=True)

    def run(batches):
        if states:
            log = logged(rows(batches), config)
            while own := list(itertools.islice(log, ROWS)):
                table = pd.DataFrame(own, columns=["video_id", *LOG, *NET]).rename(columns={"frame": "frame_idx", "after": "state", "shown_x": "ball_x", "shown_y": "ball_y"})
                yield from _batches(table, STATES)
        else:
            for table in rallies_of(rows(batches), config):
                yield from _batches(table, RALLIES)

    return dealt.mapInArrow(run, STATES if states else RALLIES)


def _batches(table: pd.DataFrame, columns: str) -> list[pa.RecordBatch]:
    schema = lockstep.arrow_schema(columns)
    return pa.Table.from_pandas(table[schema.names], schema, preserve_index=False).to_batches(max_chunksize=10_000)
