"""Rallies from the ball and the net alone: idle, tracking, active or lost.

`trace` goes through frames in order, as it must: which ball is linked hangs on the one before and on
the state.  It leaves a log of states and linked balls; everything that is counted or
scored is a column over that log, by play.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass(frozen=True)
class CourtConfig:
    confidence: float = 0.5
    stable_frames: int = 3
    motion: float = 0.004
    lost_sec: float = 1.2
    still_sec: float = 1.5
    still_step: float = 0.008
    reach: float = 0.12
    margin_x: float = 0.06
    margin_y: float = 0.06
    least_sec: float = 0.6


#: From each state, what leads where; the first that holds counts, and without any the state stays.
NEXT = {
    "idle": (("linked", "tracking"),),
    "tracking": (("settled", "active"), ("vanished", "idle")),
    "active": (("missing", "lost"), ("resting", "idle")),
    "lost": (("linked", "active"), ("late", "idle")),
}
NET = ["net_x", "net_y", "net_w", "net_h"]
LOG = ["frame", "t", "before", "after", "play", "x", "y", "conf", "shown_x", "shown_y"]
#: Rows of plays that are counted at once.
ROWS = 50_000
Ball = tuple[float, float, float]
Net = tuple[float, float, float, float]


def _link(balls: list[Ball], last: Ball | None, ahead: tuple[float, float], reach: float, low: float, high: float) -> Ball | None:
    """The ball nearest to where it should be, if in reach; without an earlier one the surest between low and high."""
    if last is None:
        return max((b for b in balls if low <= b[0] < high), key=lambda b: b[2], default=None)
    away = [math.hypot(b[0] - ahead[0], b[1] - ahead[1]) for b in balls]
    best = min(range(len(away)), key=away.__getitem__, default=-1)
    return balls[best] if away and away[best] <= reach else None


def trace(frames: Iterable[tuple[int, float, list[Ball]]], net: Net, config: CourtConfig = CourtConfig()) -> pd.DataFrame:
    """The log of frames (number, time, balls as x, y, confidence): states before and after, the linked ball, the play it belongs to."""
    return pd.DataFrame(followed(frames, net, config), columns=LOG)


def followed(frames: Iterable[tuple[int, float, list[Ball]]], net: Net, config: CourtConfig = CourtConfig()) -> Iterator[tuple]:
    """The rows of the log, one as each frame comes.

    The edges on the far sides do not belong to the court.
    """
    low = max(0.0, net[0])
    high = max(low, min(1.0, net[0] + net[2]))
    wide = max(0.0, low - config.margin_x), min(1.0, high + config.margin_x)
    state, last, speed, seen_t, clock = "idle", None, (0.0, 0.0), 0.0, None
    settled = missed = play = 0
    rest = 0.0
    for frame, t, every in frames:
        near = [b for b in every if b[2] >= config.confidence and wide[0] <= b[0] < wide[1] and 0 <= b[1] < 1]
        wait = max(0.0, t - seen_t)
        ahead = (last[0] + speed[0] * wait, last[1] + speed[1] * wait) if last else (0.0, 0.0)
        ball = _link(near, last, ahead, config.reach * (2 if state == "lost" else 1), low, high)
        step = (ball[0] - last[0], ball[1] - last[1]) if ball and last else (0.0, 0.0)
        moved = math.hypot(*step)
        lag, before = t - seen_t, state
        if ball:
            span = max(1e-3, lag)
            speed, last, seen_t, missed = (step[0] / span, step[1] / span), ball, t, 0
            settled = settled + 1 if state == "tracking" else 1
            rest = rest + (0.0 if clock is None else max(0.0, t - clock)) if state == "active" and moved < config.still_step else 0.0
        else:
            missed += 1
        says = {
            "linked": ball is not None,
            "missing": ball is None,
            "settled": ball is not None and settled >= config.stable_frames and moved >= config.motion,
            "vanished": ball is None and missed > config.stable_frames,
            "resting": rest > config.still_sec,
            "late": ball is None and lag > config.lost_sec,
        }
        state = next((to for word, to in NEXT[before] if says[word]), before)
        starts = before == "tracking" and state == "active"
        play += starts
        shown = ball or (last if state == "lost" else None)
        yield (frame, t, before, state, play if starts or before in ("active", "lost") else 0, *(ball or (np.nan,) * 3), *(shown[:2] if shown else (np.nan, np.nan)))
        if state == "idle":
            last, rest = None, 0.0
        clock = t


def rallies(log: pd.DataFrame, net: Net, config: CourtConfig = CourtConfig()) -> pd.DataFrame:
    """One row per play of a log that lasts long enough, with what is counted over it."""
    rows = log[log.play > 0].assign(**dict(zip(NET, net, strict=True)))
    out = plays(rows, config).reset_index(drop=True)
    out.insert(0, "rally_id", np.arange(1, len(out) + 1))
    return out


def plays(rows: pd.DataFrame, config: CourtConfig) -> pd.DataFrame:
    """The same of rows with their nets, from any videos; `play` is of one video only, and the index of what comes."""
    rows = rows.copy()
    rows["hit"], counted = rows.x.notna(), rows.before != "tracking"
    hits = rows[rows.hit].copy()
    side = (hits.y < hits.net_y + hits.net_h / 2).astype(int)
    hits["changes"] = (hits.before == "active") & (side.groupby(hits.play).diff().fillna(0) != 0)
    hits["crosses"] = hits.changes & hits.x.between(hits.net_x, hits.net_x + hits.net_w)
    by = rows.groupby("play")
    out = pd.DataFrame({"start_frame": by.frame.first(), "start_time": by.t.first(), "before": by.before.last(), "after": by.after.last(), "last_frame": by.frame.last(), "last_time": by.t.last()})
    out["n"], out["hits"] = counted.groupby(rows.play).sum(), (counted & rows.hit).groupby(rows.play).sum()
    out["mean"] = rows.conf.where(counted).groupby(rows.play).mean().fillna(0.0)
    out["lost_events"] = ((rows.before == "active") & ~rows.hit).groupby(rows.play).sum()
    seen = hits.groupby("play")
    out["side_changes"], out["net_crossings"] = seen.changes.sum(), seen.crosses.sum()
    rested = (out.before == "active") & (out.after == "idle")
    out["end_frame"], out["end_time"] = seen.frame.last().where(~rested, out.last_frame), seen.t.last().where(~rested, out.last_time)
    out["end_reason"] = np.where(rested, "ball stationary", np.where(out.after == "idle", "ball absent (timeout)", "video ended"))
    took = out.end_time - out.start_time
    kept = (out.hits / out.n.where(out.n > 0)).fillna(0.0)
    score = 30 * kept + 20 * out["mean"] + 20 * np.minimum(1, took / 5) + 15 * np.minimum(1, out.side_changes / 3) + 15 * np.minimum(1, out.net_crossings / 2)
    out["confidence"] = np.floor(score.clip(0, 100) + 0.5).astype(int)
    return out[took >= config.least_sec][["start_frame", "end_frame", "start_time", "end_time", "net_crossings", "side_changes", "lost_events", "confidence", "end_reason"]]


def frames_of(rows: Iterable[tuple]) -> Iterator[tuple[int, float, list[Ball]]]:
    """Frames of rows (video, t, frame, x, y, w, h, confidence, ...) of one video in time; a row whose x is NaN is no ball."""
    for (t, frame), own in itertools.groupby(rows, key=lambda r: r[1:3]):
        yield int(frame), t, [(r[3] + r[5] / 2, r[4] + r[6] / 2, r[7]) for r in own if r[3] == r[3]]


def logged(rows: Iterable[tuple], config: CourtConfig) -> Iterator[tuple]:
    """Rows of the logs of videos that stream by, each with its video's id before and its net behind."""
    for video, own in itertools.groupby(rows, key=lambda r: r[0]):
        first = next(own)
        net = first[8:]
        for row in followed(frames_of(itertools.chain([first], own)), net, config):
            yield video, *row, *net


def rallies_of(rows: Iterable[tuple], config: CourtConfig, size: int = ROWS) -> Iterator[pd.DataFrame]:
    """Rallies of videos that stream by, with video_id: counted together over whole plays of about `size` rows."""
    held, last, total, number = [], None, {}, 0

    def counted() -> pd.DataFrame:
        table = pd.DataFrame(held, columns=["video_id", "number", *LOG, *NET])
        table["play"] = table.number
        out = plays(table, config)
        out.insert(0, "video_id", table.groupby("play").video_id.first().loc[out.index])
        before = out.video_id.map(total).fillna(0).astype(int)
        out.insert(1, "rally_id", before + out.groupby("video_id").cumcount() + 1)
        count = out.video_id.iloc[-1] if len(out) else None
        kept = {last[0]: int(out.rally_id.iloc[-1])} if count == last[0] else {last[0]: total.get(last[0], 0)}
        total.clear()
        total.update(kept)
        return out

    for row in logged(rows, config):
        if not row[5]:
            continue
        if (row[0], row[5]) != last:
            if len(held) >= size:
                yield counted()
                held.clear()
            last, number = (row[0], row[5]), number + 1
        held.append((row[0], number, *row[1:]))
    if held:
        yield counted()
