"""The choice among a frame's fresh tracks, for the frames of many videos at once.

Frames and points stream by, sorted by video and time.  A point stands for its track from its
time on, until the track's next point or until it is no longer fresh: a range of frames, found by places
in the sorted rows.  Only where a frame has two valid tracks or more is it looked at by itself, as there the choice before counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import lockstep
from .config import Config

EVIDENCE = "video_id string, t double, has_ball boolean, is_projectile boolean, ball_y double, track_id long, score double"
TRAITS = ("gate_confidence", "acceleration", "mean_area", "y")


def candidates(video: np.ndarray, t: np.ndarray, is_frame: np.ndarray, track: np.ndarray, fresh: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the frame, row of the point) of each frame's fresh tracks, by frame and track; rows are sorted by video and t, points first."""
    points, at = np.flatnonzero(~is_frame), np.cumsum(is_frame)
    frames = np.flatnonzero(is_frame)
    order = points[np.lexsort((points, track[points], video[points]))]
    first = at[order]
    end = np.zeros(len(t), np.int64)
    of, bounds = video[frames], lockstep.beginnings(video[points])
    for a, b in zip(bounds, np.append(bounds, len(points))[1:], strict=True):
        low, high = np.searchsorted(of, [video[points[a]], video[points[a]] + 1])
        end[points[a:b]] = low + np.searchsorted(t[frames[low:high]], t[points[a:b]] + fresh, "right")
    end = end[order]
    same = np.flatnonzero((video[order][1:] == video[order][:-1]) & (track[order][1:] == track[order][:-1]))
    end[same] = np.minimum(end[same], first[same + 1])
    count = np.maximum(end - first, 0)
    frame, row = lockstep.places(first, count), np.repeat(order, count)
    by = np.lexsort((track[row], frame))
    return frame[by], row[by]


def choose(frame: np.ndarray, track: np.ndarray, score: np.ndarray, video: np.ndarray, before: int, config: Config) -> np.ndarray:
    """For each frame the place of its chosen one among the valid candidates (frame, track, score), or -1.

    video: of each frame; before: the track chosen before the first frame, or -1.
    """
    out = np.full(len(video), -1)
    starts = lockstep.beginnings(frame)
    ends = np.append(starts, len(frame))[1:]
    single = ends - starts == 1
    out[frame[starts[single]]] = starts[single]
    for a, b in zip(starts[~single].tolist(), ends[~single].tolist(), strict=True):
        f = int(frame[a])
        best = a + max(range(b - a), key=score[a:b].tolist().__getitem__)
        held = before if f == 0 else track[out[f - 1]] if video[f - 1] == video[f] and out[f - 1] >= 0 else -1
        kept = a + int(np.searchsorted(track[a:b], held))
        stays = kept < b and track[kept] == held and score[kept] >= score[best] - config.stickiness
        out[f] = kept if stays else best
    return out


def chosen(batches: Iterator[pa.RecordBatch], config: Config, size: int = lockstep.PORTION) -> Iterator[pa.RecordBatch]:
    """EVIDENCE of rows sorted by video_id, t and is_frame: frames, distinct, and points of tracks."""
    schema, earlier, before, c = lockstep.arrow_schema(EVIDENCE), None, -1, config

    def last_time(table: pa.Table) -> int:
        return int(lockstep.beginnings(lockstep.codes(table, "video_id"), lockstep.numbers(table, "t"))[-1])

    for own, more in lockstep.portions(batches, last_time, size):
        first_video = own.column("video_id")[0].as_py()
        going = earlier is not None and earlier.num_rows > 0 and earlier.column("video_id")[0].as_py() == first_video
        table = pa.concat_tables([earlier, own]).combine_chunks() if going else own
        video, t, is_frame = lockstep.codes(table, "video_id"), lockstep.numbers(table, "t"), lockstep.numbers(table, "is_frame").astype(bool)
        track = lockstep.numbers(table, "track_id", -1)
        frames = np.flatnonzero(is_frame)
        frame, row = candidates(video, t, is_frame, track, c.fresh_sec)
        valid = lockstep.numbers(table, "is_valid", False)[row]
        sure, pull, area, y = (lockstep.numbers(table, name) for name in TRAITS)
        age = lockstep.numbers(table, "age")
        frame_v, row_v = frame[valid], row[valid]
        largest = np.zeros(len(frames))
        np.maximum.at(largest, frame_v, area[row_v])
        most = largest[frame_v]
        share = np.divide(area[row_v], most, out=np.zeros(len(row_v)), where=most > 0)
        score = 0.5 * sure[row_v] + 0.5 * np.where(np.isnan(pull[row_v]), 0.0, pull[row_v]) + c.size_weight * share + c.age_weight * np.minimum(1.0, age[row_v] / c.age_reference)
        held = before if going and len(frames) and video[frames[0]] == 0 else -1
        picked = choose(frame_v, track[row_v], score, video[frames], held, c)
        hit = np.flatnonzero(picked >= 0)
        has_ball, ball_y = np.zeros(len(frames), bool), np.full(len(frames), np.nan)
        last = np.flatnonzero(np.append(frame[1:] != frame[:-1], True)) if len(frame) else frame
        has_ball[frame[last]], ball_y[frame[last]] = True, y[row[last]]
        ball_y[hit] = y[row_v[picked[hit]]]
        ids, scores = np.zeros(len(frames), np.int64), np.zeros(len(frames))
        ids[hit], scores[hit] = track[row_v[picked[hit]]], score[picked[hit]]
        names = table.column("video_id").take(pa.array(frames))
        values = [names, pa.array(t[frames]), pa.array(has_ball), pa.array(picked >= 0), pa.array(ball_y, mask=~has_ball), pa.array(ids, mask=picked < 0), pa.array(scores, mask=picked < 0)]
        yield from pa.table(values, schema=schema).to_batches(max_chunksize=10_000)
        if more:
            on = np.flatnonzero((video == video[-1]) & ~is_frame & (t + c.fresh_sec >= t[-1]))
            earlier = table.take(pa.array(on))
            if len(frames) and video[frames[-1]] == video[-1]:
                before = int(ids[-1]) if picked[-1] >= 0 else -1
            elif not (going and video[-1] == 0):
                before = -1
