"""Whether play is on: two conditions of each frame, and a switch with a delay between them.

What a frame's conditions hang on is a small memory of the input: the last ball, its
height, the last flight, the run of flights that still holds, and the balls of the last
moments.  It never hangs on the switch, and two stretches of it can be put together, so
a video is cut anywhere and its pieces are worked on side by side:

1. each piece is summed up as what it does to any memory (`Digest`);
2. digests are put together in order, which gives each piece the memory it begins with;
3. each piece finds its conditions by columns, and what the switch comes to at its end for any
   way of entering it (`Exits`): off, or on since some time;
4. exits are followed in order, which gives each piece the switch it begins with;
5. each piece is decided.

Only steps 2 and 4 go through a video in order, over one row a piece.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .config import Config

#: The longest wait for a ball, and when few balls after a flight end play.
LONGEST_WAIT, THIN_AFTER, THIN_RATE = 0.8, 1.5, 0.5
#: Spans of time that are worked on at once.
CUT = 600.0
#: Rows up to which neighbouring spans of a video are one piece.
PIECE_ROWS = 4096


@dataclass
class Memory:
    """What earlier frames leave: times of the last ball and flight, where the run of flights began, frames without a flight since."""

    ball: float | None = None
    height: float | None = None
    flight: float | None = None
    run: float | None = None
    missed: int = 0
    balls: list[float] = field(default_factory=list)


@dataclass
class Digest:
    """A piece: its frames, those before its first and after its last flight, where its first flight is and, after a break, its last run began."""

    frames: int
    lead: int
    trail: int
    first: float | None
    begin: float | None
    ball: float | None
    height: float | None
    flight: float | None
    balls: list[float]
    end: float


def _latest(at: np.ndarray, values: np.ndarray, before: float | None, none: float) -> np.ndarray:
    """For each row the value at the last place up to it where `at` holds; before the first, `before`."""
    place = np.maximum.accumulate(np.where(at, np.arange(len(at)), -1))
    return np.where(place >= 0, values[np.maximum(place, 0)], none if before is None else before)


def _only(values: np.ndarray) -> float | None:
    return float(values[-1]) if len(values) else None


def _breaks(flights: np.ndarray, grace: int) -> np.ndarray:
    """Of flights at these frames, those with more than `grace` frames since the flight before."""
    return np.flatnonzero(np.diff(flights) - 1 > grace) + 1


def digest(t: np.ndarray, ball: np.ndarray, flight: np.ndarray, height: np.ndarray, config: Config) -> Digest:
    at, n = np.flatnonzero(flight), len(t)
    broken = _breaks(at, config.grace_frames)
    balls = t[ball]
    return Digest(
        frames=n,
        lead=int(at[0]) if len(at) else n,
        trail=n - 1 - int(at[-1]) if len(at) else n,
        first=float(t[at[0]]) if len(at) else None,
        begin=float(t[at[broken[-1]]]) if len(broken) else None,
        ball=_only(balls),
        height=_only(height[ball & ~np.isnan(height)]),
        flight=_only(t[at]),
        balls=balls[balls >= t[-1] - config.evidence_sec].tolist(),
        end=float(t[-1]),
    )


def after(memory: Memory, piece: Digest, config: Config) -> Memory:
    """The memory after a piece."""
    known = lambda new, old: old if new is None else new
    if piece.first is None:
        missed, run = memory.missed + piece.frames, memory.run
    else:
        held = memory.run is not None and memory.missed + piece.lead <= config.grace_frames
        missed, run = piece.trail, known(piece.begin, memory.run if held else piece.first)
    balls = [x for x in [*memory.balls, *piece.balls] if x >= piece.end - config.evidence_sec]
    return Memory(known(piece.ball, memory.ball), known(piece.height, memory.height), known(piece.flight, memory.flight), run if missed <= config.grace_frames else None, missed, balls)


def conditions(memory: Memory, t: np.ndarray, ball: np.ndarray, flight: np.ndarray, height: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Whether play may start, and whether it may end, at each frame after `memory`."""
    n, at = len(t), np.flatnonzero(flight)
    since_ball = t - _latest(ball, t, memory.ball, -np.inf)
    since_flight = t - _latest(flight, t, memory.flight, -np.inf)
    high = _latest(ball & ~np.isnan(height), height, memory.height, 0.0) >= config.sky_y

    place = np.cumsum(flight) - 1  # the last flight's number
    missed = np.where(place >= 0, np.arange(n) - at[np.maximum(place, 0)] if len(at) else 0, memory.missed + np.arange(n) + 1)
    fresh = np.zeros(len(at), bool)
    fresh[_breaks(at, config.grace_frames)] = True
    if len(at):
        fresh[0] = memory.run is None or memory.missed + at[0] > config.grace_frames
    begin = _latest(fresh, t[at], memory.run, np.inf)
    run = np.where(place >= 0, begin[np.maximum(place, 0)] if len(at) else np.inf, np.inf if memory.run is None else memory.run)
    may_start = (missed <= config.grace_frames) & (t - run >= config.start_buffer)

    balls = np.concatenate([memory.balls, t[ball]])
    recent = len(memory.balls) + np.cumsum(ball) - np.searchsorted(balls, t - config.evidence_sec)
    thin = (since_flight > THIN_AFTER) & (recent / max(config.evidence_sec, 0.001) < THIN_RATE)
    waited = np.where(high, since_ball >= config.sky_timeout, (since_ball >= min(LONGEST_WAIT, config.end_timeout)) | thin)
    return may_start, waited & (since_flight > config.recent_sec)


@dataclass
class Exits:
    """What the switch comes to at the end of a piece: `off` if it enters off; else, by the first of `ends` that is late enough, `then`.

    Times since when it is on; None is off.
    """

    off: float | None
    ends: list[float]
    then: list[float | None]

    def leave(self, since: float | None, config: Config) -> float | None:
        if since is None:
            return self.off
        return next((then for end, then in zip(self.ends, self.then, strict=True) if end - since >= config.min_active_sec), since)


def _end_of(t: np.ndarray, ends: np.ndarray, since: float, at: int, config: Config) -> int | None:
    """The first frame from `at` on, of those that may end, that is late enough."""
    k = int(np.searchsorted(ends, at))
    k += int(np.searchsorted(t[ends[k:]] - since, config.min_active_sec))
    return int(ends[k]) if k < len(ends) else None


def exits(t: np.ndarray, may_start: np.ndarray, may_end: np.ndarray, config: Config) -> Exits:
    starts, ends = np.flatnonzero(may_start), np.flatnonzero(may_end)
    out: list[float | None] = [None] * (len(starts) + 1)  # of being off before each start
    from_start = lambda at: out[int(np.searchsorted(starts, at))]
    for k in range(len(starts) - 1, -1, -1):
        since = float(t[starts[k]])
        end = _end_of(t, ends, since, int(starts[k]) + 1, config)
        out[k] = since if end is None else from_start(end + 1)
    table: list[tuple[float, float | None]] = []
    for end in ends.tolist():
        then = from_start(end + 1)
        if table and table[-1][1] == then:
            table.pop()
        table.append((float(t[end]), then))
    return Exits(out[0], [x[0] for x in table], [x[1] for x in table])


def switched(t: np.ndarray, may_start: np.ndarray, may_end: np.ndarray, since: float | None, config: Config) -> tuple[np.ndarray, float | None]:
    """Whether play is on after each frame, and since when after the last."""
    starts, ends, active, at = np.flatnonzero(may_start), np.flatnonzero(may_end), np.zeros(len(t), bool), 0
    while at < len(t):
        if since is None:
            k = int(np.searchsorted(starts, at))
            if k == len(starts):
                break
            at, since = int(starts[k]), float(t[starts[k]])
            active[at] = True
            at += 1
        end = _end_of(t, ends, since, at, config)
        active[at : len(t) if end is None else end] = True
        if end is None:
            break
        at, since = end + 1, None
    return active, since


def decided(memory: Memory, since: float | None, frames: tuple[np.ndarray, ...], config: Config) -> tuple[np.ndarray, Memory, float | None]:
    """Whether play is on after each of frames (t, ball, flight, height), and what they leave."""
    may_start, may_end = conditions(memory, *frames, config)
    active, since = switched(frames[0], may_start, may_end, since, config)
    return active, after(memory, digest(*frames, config), config), since


def columns_of(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """t, ball, flight and height of rows(t, has_ball, is_projectile, ball_y) in time."""
    flag = lambda c: rows[c].fillna(False).to_numpy().astype(bool)
    return rows.t.to_numpy(float), flag("has_ball"), flag("is_projectile"), rows.ball_y.to_numpy(float)


class Decider:
    """One frame after another."""

    def __init__(self, config: Config = Config()):
        self.config, self.memory, self.since = config, Memory(), None

    def step(self, t: float, has_ball: bool, is_flight: bool, ball_y: float | None) -> bool:
        frame = np.array([t], float), np.array([has_ball], bool), np.array([is_flight], bool), np.array([ball_y], float)
        active, self.memory, self.since = decided(self.memory, self.since, frame, self.config)
        return bool(active[0])


def decide(frames: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("video_id",), cut: float = CUT, rows_each: int = PIECE_ROWS) -> DataFrame:
    """keys, t and is_active of each row of frames(keys, t, has_ball, is_projectile, ball_y); rows with one time keep no order.

    Pieces are worked on side by side, so a video may hold any share of the rows.  A piece is one or more
    neighbouring spans of `cut` units of time: spans of a video go together until they hold `rows_each` rows, so
    pieces are not more than the rows call for.  The result does not hang on either.  Null flags are false; rows with a null time are left out.
    """
    names = [*keys, "piece"]
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    rows = frames.where("t is not null").select(*keys, F.floor(F.col("t").cast("double") / cut).alias("piece"), F.struct(F.col("t").cast("double").alias("t"), flag("has_ball"), flag("is_projectile"), F.coalesce(F.col("ball_y").cast("double"), F.lit(float("nan"))).alias("ball_y")).alias("frame"))
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    same = lambda a, b: [a[c].eqNullSafe(b[f"of_{c}"]) for c in names]

    def digested(batches):
        for batch in batches:
            yield batch[names].assign(digest=[json.dumps(asdict(digest(r.t, r.has_ball, r.is_projectile, r.ball_y, config))) for r in batch.itertuples()])

    def remembered(batches):
        for batch in batches:
            found = []
            for digests in batch["own"]:
                memory, out = Memory(), []
                for text in digests:
                    out.append(json.dumps(asdict(memory)))
                    memory = after(memory, Digest(**json.loads(text)), config)
                found.append(out)
            yield batch[[*keys, "piece"]].assign(memory=found)

    def judged(batches):
        for batch in batches:
            found = []
            for r in batch.itertuples():
                may = conditions(Memory(**json.loads(r.memory)), r.t, r.has_ball, r.is_projectile, r.ball_y, config)
                found.append((may[0].tolist(), may[1].tolist(), json.dumps(asdict(exits(r.t, *may, config)))))
            yield batch[[*names, "t"]].assign(**{c: [f[k] for f in found] for k, c in enumerate(("may_start", "may_end", "exits"))})

    def followed(batches):
        for batch in batches:
            found = []
            for tables in batch["own"]:
                since, out = None, []
                for text in tables:
                    out.append(since)
                    since = Exits(**json.loads(text)).leave(since, config)
                found.append(out)
            yield batch[[*keys, "piece"]].assign(since=found)

    def in_order(pieces: DataFrame, what: str, run, out: str, kind: str) -> DataFrame:
        """A row per piece with what `run` makes of all pieces of its video, one text each, in order."""
        own = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", F.col(what).alias("text")))).alias("own"))
        made = own.select(*keys, F.col("own.piece").alias("piece"), F.col("own.text").alias("own")).mapInPandas(run, f"{keyed}, piece array<bigint>, {out} array<{kind}>")
        flat = made.select(*keys, F.explode(F.arrays_zip("piece", out)).alias("x")).select(*[F.col(c).alias(f"of_{c}") for c in keys], F.col("x.piece").alias("of_piece"), f"x.{out}")
        return flat

    def entered(batches):
        for batch in batches:
            active = [switched(r.t, r.may_start, r.may_end, None if pd.isna(r.since) else r.since, config)[0].tolist() for r in batch.itertuples()]
            yield batch[[*keys, "t"]].assign(active=active)

    spans = rows.groupBy(*names).agg(F.collect_list("frame").alias("frames"))
    earlier = F.sum("n").over(Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = spans.select(*names, F.size("frames").alias("n"))
    into = sizes.select(*[F.col(c).alias(f"of_{c}") for c in names], F.floor(F.coalesce(earlier, F.lit(0)) / rows_each).alias("into"))
    gathered = spans.join(into, same(spans, into)).select(*keys, F.col("into").alias("piece"), "frames")
    pieces = gathered.groupBy(*names).agg(F.array_sort(F.flatten(F.collect_list("frames"))).alias("frames")).select(*names, *[F.col(f"frames.{c}").alias(c) for c in ("t", "has_ball", "is_projectile", "ball_y")])
    digests = pieces.mapInPandas(digested, f"{named}, digest string")
    keyed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    memories = in_order(digests, "digest", remembered, "memory", "string")
    found = pieces.join(memories, same(pieces, memories)).select(*pieces.columns, "memory").mapInPandas(judged, f"{named}, t array<double>, may_start array<boolean>, may_end array<boolean>, exits string")
    states = in_order(found.select(*names, "exits"), "exits", followed, "since", "double")
    out = found.join(states, same(found, states)).select(*found.columns, "since").mapInPandas(entered, f"{keyed}, t array<double>, active array<boolean>")
    return out.select(*keys, F.explode(F.arrays_zip("t", F.col("active").alias("is_active"))).alias("x")).select(*keys, "x.t", "x.is_active")
