"""Replays of many videos under many parameters at once, and what they score.

The conditions of frames that hang on no swept parameter are found once; the switch goes through all videos
and parameters in step; runs, segments, pairs and matches are places in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .config import Config
from .decider import LONGEST_WAIT, THIN_AFTER, THIN_RATE
from .lockstep import beginnings, mutual_best, places

#: Frames that are replayed at once.
FRAMES = 40_000
SUMS = ("n_pred", "tp", "start_in", "end_in", "start_err", "end_err")


def _since(at: np.ndarray, t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame the last place up to it in its video where `at` holds, or -1, and the time since then, or infinity."""
    place = np.maximum.accumulate(np.where(at, np.arange(len(t)), -1))
    place = np.where(place >= begin, place, -1)
    return place, np.where(place >= 0, t - t[place], np.inf)


def may(lengths: np.ndarray, t: np.ndarray, ball: np.ndarray, flight: np.ndarray, height: np.ndarray, params: list[dict], base: Config) -> tuple[np.ndarray, np.ndarray]:
    """Whether play may start and may end, as `decider.conditions` from no memory: a row per frame, a column per parameters."""
    first = np.cumsum(lengths) - lengths
    begin, n = np.repeat(first, lengths), len(t)
    since_ball, (last, since_flight) = _since(ball, t, begin)[1], _since(flight, t, begin)
    known = _since(ball & ~np.isnan(height), t, begin)[0]
    high = np.where(known >= 0, height[known], 0.0) >= base.sky_y
    balls = np.concatenate([[0], np.cumsum(ball)])
    old = np.zeros(n, np.int64)
    for a, k in zip(first.tolist(), lengths.tolist(), strict=True):
        own = t[a : a + k]
        old[a : a + k] = a + np.searchsorted(own, own - base.evidence_sec)
    recent = balls[1:] - balls[old]
    thin = (since_flight > THIN_AFTER) & (recent / max(base.evidence_sec, 0.001) < THIN_RATE)
    missed = np.arange(n) - np.where(last >= 0, last, begin - 1)
    flights = np.flatnonzero(flight)
    starts, ends = np.zeros((n, len(params)), bool), np.zeros((n, len(params)), bool)
    over = since_flight > base.recent_sec
    runs = {}
    for p, own in enumerate(params):
        grace = round(own["grace_frames"])
        if grace not in runs:
            fresh = np.zeros(n, bool)
            fresh[flights] = np.append(True, (np.diff(flights) - 1 > grace) | (begin[flights[1:]] != begin[flights[:-1]]))[: len(flights)]
            place = _since(fresh, t, begin)[0]
            runs[grace] = np.where((place >= 0) & (missed <= grace), t - t[place], -np.inf)
        starts[:, p] = runs[grace] >= own["start_buffer"]
        ends[:, p] = np.where(high, since_ball >= base.sky_timeout, (since_ball >= min(LONGEST_WAIT, own["end_timeout"])) | thin) & over
    return starts, ends


def switched(lengths: np.ndarray, t: np.ndarray, may_start: np.ndarray, may_end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether play is on after each frame; `least` is each column's least time in play."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, left = first[order], lengths[order]
    since, active = np.full((len(order), may_start.shape[1]), np.nan), np.zeros(may_start.shape, bool)
    for k in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-left, -k))
        at = first[:live] + k
        own, now = since[:live], t[at][:, None]
        on = ~np.isnan(own)
        own[:] = np.where(on & may_end[at] & (now - own >= least), np.nan, np.where(~on & may_start[at], now, own))
        active[at] = ~np.isnan(own)
    return active


def segments(lengths: np.ndarray, t: np.ndarray, active: np.ndarray, gap: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """column, video, number, start, end of runs of play with short gaps closed, those that are long enough."""
    first = np.cumsum(lengths) - lengths
    video, on = np.repeat(np.arange(len(lengths)), lengths), active.T
    opens, shuts = on.copy(), on.copy()
    inner = np.ones(len(t), bool)
    inner[first[lengths > 0]] = False
    opens[:, 1:] &= ~(on[:, :-1] & inner[1:])
    shuts[:, :-1] &= ~(on[:, 1:] & inner[1:])
    (p, a), b = np.nonzero(opens), np.nonzero(shuts)[1]
    last = (first + lengths - 1)[video[a]]
    start, end = t[a], t[np.minimum(b + 1, last)]
    stream = p * len(lengths) + video[a]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (stream[1:] != stream[:-1]) | (start[1:] - end[:-1] > gap[p[1:]])
    head = np.flatnonzero(fresh)
    tail = np.append(head, len(p))[1:] - 1
    kept = end[tail] - start[head] >= least[p[head]]
    head, tail = head[kept], tail[kept]
    begun = beginnings(stream[head])
    number = np.arange(len(head)) - np.repeat(begun, np.diff(np.append(begun, len(head))))
    return p[head], video[a[head]], number, start[head], end[tail]


def scored(lengths: np.ndarray, frames: tuple[np.ndarray, ...], n_truth: np.ndarray, truth: tuple[np.ndarray, ...], params: list[dict], base: Config, tolerance: float = 0.5, least_iou: float = 0.5) -> dict[str, np.ndarray]:
    """SUMS over videos for each of params; truth: number, start and end, by video and start."""
    t, column = frames[0], lambda name: np.array([own[name] for own in params])
    active = switched(lengths, t, *may(lengths, *frames, params, base), column("min_active_sec"))
    p, video, number, start, end = segments(lengths, t, active, column("merge_gap"), column("min_length"))
    t_number, t_start, t_end = truth
    low, high = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    by_video = np.argsort(video, kind="stable")
    bounds = np.searchsorted(video[by_video], np.arange(len(lengths) + 1))
    first = np.cumsum(n_truth) - n_truth
    for v in np.flatnonzero((np.diff(bounds) > 0) & (n_truth > 0)).tolist():
        rows, own = by_video[bounds[v] : bounds[v + 1]], slice(first[v], first[v] + n_truth[v])
        low[rows] = first[v] + np.searchsorted(np.maximum.accumulate(t_end[own]), start[rows], "right")
        high[rows] = first[v] + np.searchsorted(t_start[own], end[rows])
    count = np.maximum(high - low, 0)
    a, b = np.repeat(np.arange(len(p)), count), places(low, count)
    shared = np.maximum(0.0, np.minimum(end[a], t_end[b]) - np.maximum(start[a], t_start[b]))
    union = np.maximum(0.0, end[a] - start[a]) + np.maximum(0.0, t_end[b] - t_start[b]) - shared
    iou = np.divide(shared, union, out=np.zeros(len(a)), where=union > 0)
    good = (start[a] < t_end[b]) & (end[a] > t_start[b]) & (iou >= least_iou)
    a, b, iou = a[good], b[good], iou[good]
    order = np.lexsort((t_number[b], number[a], -iou))
    a, b = a[order], b[order]
    taken = mutual_best(np.unique(a, return_inverse=True)[1], np.unique(p[a] * max(1, len(t_start)) + b, return_inverse=True)[1])
    a, b = a[taken], b[taken]
    start_err, end_err = np.abs(start[a] - t_start[b]), np.abs(end[a] - t_end[b])
    total = lambda of, weights=None: np.bincount(of, weights, len(params)).astype(float)
    found = total(p), total(p[a]), total(p[a], start_err <= tolerance), total(p[a], end_err <= tolerance), total(p[a], start_err), total(p[a], end_err)
    return dict(zip(SUMS, found, strict=True))


def lists(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths and values of columns of lists that are equally long; a null list is empty."""
    columns = [batch.column(c) for c in names]
    lengths = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = [c.flatten() for c in columns]
    return lengths, [(c.fill_null(False) if pa.types.is_boolean(c.type) else c).to_numpy(zero_copy_only=False) for c in flat]


def replayed(batch: pa.RecordBatch, params: list[dict], base: Config) -> dict[str, np.ndarray]:
    """SUMS of a batch of videos: lists t, has_ball, is_projectile, ball_y of frames in time and seg_idx, start, end of labels by start."""
    lengths, frames = lists(batch, ("t", "has_ball", "is_projectile", "ball_y"))
    n_truth, truth = lists(batch, ("seg_idx", "start", "end"))
    sums = {c: np.zeros(len(params)) for c in SUMS}
    ends, marks, v = np.cumsum(lengths), np.cumsum(n_truth), 0
    while v < len(lengths):
        before, marked = (int(ends[v - 1]), int(marks[v - 1])) if v else (0, 0)
        w = max(v + 1, int(np.searchsorted(ends, before + FRAMES, "right")))
        found = scored(lengths[v:w], tuple(x[before : ends[w - 1]] for x in frames), n_truth[v:w], tuple(x[marked : marks[w - 1]] for x in truth), params, base)
        sums, v = {c: sums[c] + found[c] for c in SUMS}, w
    return sums
