"""Cleaning detections: decoding, thresholds, same-frame suppression and static suppression.

A detection row: video_id, frame_idx, t, det_idx, x, y, w, h (left lower corner and
size in shares of the picture), conf and, where it matters, label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import box_iou
from .config import Config


def decode(rows: DataFrame, input_size: tuple[float, float], source_size: tuple[float, float], letterbox: bool, least: float) -> DataFrame:
    """Boxes of raw rows (…, `raw` array of x1, y1, x2, y2, conf, class): shares of the source, y upwards.

    Rows with less confidence, or without a positive size, go; coordinates up to 1.5
    are shares of the input, others its pixels; a letterboxed input loses its borders.
    """
    (iw, ih), (sw, sh) = input_size, source_size
    x1, y1, x2, y2, conf = (F.get("raw", F.lit(k)).cast("double") for k in range(5))
    usable = (F.size("raw") >= 6) & (conf >= least) & (x2 > x1) & (y2 > y1)
    share = F.greatest(x1, y1, x2, y2) <= 1.5
    boxed = letterbox and sw > 0 and sh > 0
    s = min(iw / sw, ih / sh) if boxed else 1.0
    across = lambda v: (F.when(share, v * iw).otherwise(v) - ((iw - sw * s) / 2 if boxed else 0.0)) / (sw * s if boxed else iw)
    up = lambda v: (F.when(share, v * ih).otherwise(v) - ((ih - sh * s) / 2 if boxed else 0.0)) / (sh * s if boxed else ih)
    kept = rows.where(usable)
    return kept.withColumns({"x": across(x1), "y": 1 - up(y2), "w": across(x2) - across(x1), "h": up(y2) - up(y1), "conf": conf}).drop("raw")


def confident(detections: DataFrame, config: Config = Config(), labels: tuple[str, ...] = ("volleyball", "ball")) -> DataFrame:
    return detections.where(F.lower("label").isin(*labels) & (F.col("conf") >= config.detection_confidence))


def _greedy(detections: DataFrame, clash) -> DataFrame:
    """Per frame, by falling confidence: what does not clash(kept, new) with anything kept before it.

    An ordered fold over the frame's own array; frames are small and independent.
    """
    columns = [c for c in detections.columns if c not in ("video_id", "frame_idx", "conf", "det_idx")]
    box = F.struct((-F.col("conf")).alias("rank"), "det_idx", *columns)
    frames = detections.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: clash(k, b)), acc).otherwise(F.array_append(acc, b)))
    out = frames.select("video_id", "frame_idx", F.posexplode(kept).alias("kept_idx", "b"))
    return out.select("video_id", "frame_idx", "kept_idx", "b.det_idx", *[f"b.{c}" for c in columns], (-F.col("b.rank")).alias("conf"))


def dedupe_by_center(detections: DataFrame, config: Config = Config()) -> DataFrame:
    """Of detections whose centres lie within the radius, the most confident; kept_idx gives the order kept."""
    centre = lambda b: (b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)

    def clash(k: Column, b: Column) -> Column:
        (kx, ky), (bx, by) = centre(k), centre(b)
        return F.hypot(kx - bx, ky - by) <= config.dedupe_radius

    return _greedy(detections, clash)


def suppress_overlaps(detections: DataFrame, least_iou: float = 0.45) -> DataFrame:
    """Of boxes that overlap by `least_iou` or more, the most confident."""
    return _greedy(detections, lambda k, b: box_iou(k, b) >= least_iou)


def cell(x: Column, grid: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(x * grid))).cast("int")


class StaticCell:
    """State of one grid cell: where and when it was last hit, its streak, and until when it is muted."""

    def __init__(self, config: Config):
        self.config, self.last, self.streak, self.muted_until = config, None, 0, 0.0

    def snapshot(self) -> list:
        return [self.last, self.streak, self.muted_until]

    @classmethod
    def resumed(cls, config: Config, kept: list | None) -> StaticCell:
        state = cls(config)
        if kept:
            state.last, state.streak, state.muted_until = kept
        return state

    def keeps(self, t: float, x: float, y: float) -> bool:
        lx, ly, lt = self.last or (x, y, t)
        self.last = x, y, t
        if t < self.muted_until:
            return False
        moved, took = math.hypot(x - lx, y - ly), t - lt
        still = moved < self.config.static_distance and (moved / took if took > 0 else 0.0) < self.config.static_speed
        self.streak = self.streak + 1 if still else 0
        if self.streak >= self.config.static_streak:
            self.muted_until = t + self.config.static_mute_sec
            return False
        return True


def suppress_static(detections: DataFrame, config: Config = Config(), order: str = "kept_idx") -> DataFrame:
    """Without hits of cells that stay where they are; rows of a cell go by time, then `order`.

    State is per cell of a video, and so rows are dealt: a video's cells lie in any tasks, and stream by in order.
    """
    centred = detections.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    celled = centred.withColumn("cell", cell_of(F.col("cx"), F.col("cy"), config))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, StaticCell(config)
        for batch in batches:
            kept = []
            for video, number, t, x, y in zip(*(batch.column(c).to_pylist() for c in ("video_id", "cell", "t", "cx", "cy")), strict=True):
                if (video, number) != last:
                    last, state = (video, number), StaticCell(config)
                kept.append(state.keeps(t, x, y))
            yield batch.filter(pa.array(kept, pa.bool_()))

    dealt = celled.repartition("video_id", "cell").sortWithinPartitions("video_id", "cell", "t", order)
    return dealt.mapInArrow(run, celled.schema).drop("cell", "cx", "cy")


def cell_of(x: Column, y: Column, config: Config = Config()) -> Column:
    return cell(y, config.static_grid) * config.static_grid + cell(x, config.static_grid)


def sampled(frames: DataFrame, detections: DataFrame, stride: int) -> DataFrame:
    """Every frame of a fixed stride, the first included, with its detections; empty frames stay with an empty array."""
    spine = frames.where((F.col("frame_idx") == 1) | (F.col("frame_idx") % stride == 0))
    boxes = detections.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_idx", "x", "y", "w", "h", "conf"))).alias("boxes"))
    return spine.join(boxes, ["video_id", "frame_idx"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


def median_box(detections: DataFrame, key: str = "video_id") -> DataFrame:
    """The median of each component, and the mean confidence."""
    return detections.groupBy(key).agg(*[F.median(c).alias(c) for c in ("x", "y", "w", "h")], F.avg("conf").alias("conf"))


def nearest(boxes: Column, x: Column, y: Column) -> Column:
    """Of a frame's boxes, structs of det_idx, x and y, the one nearest to a point; ties by det_idx."""
    return F.array_min(F.transform(boxes, lambda b: F.struct(F.hypot(b["x"] - x, b["y"] - y).alias("distance"), b["det_idx"].alias("det_idx"), b["x"].alias("x"), b["y"].alias("y"))))
