"""The tracker for many videos at once: every video takes its next frame in the same step.

What `kernels.Tracker` does to one frame is done here to a frame of each video, by arrays over
all their tracks.  Rows stream by, sorted by video and time; a video may begin in one
portion and go on in the next, so a portion has a bounded size whatever a video holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .config import Config

#: Rows that are worked on at once.
PORTION = 1 << 18
X, Y, VX, VY, PLACE, MIXED, SPEED, T, SEEN, MEAN, RADIUS, AGE, ID, AREAS = range(14)


def arrow_schema(columns: str) -> pa.Schema:
    """Of `name type, ...`."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def portions(batches: Iterator[pa.RecordBatch], ends, size: int = PORTION) -> Iterator[tuple[pa.Table, bool]]:
    """Rows in portions of about `size`, and whether more follow; a portion ends where ends(table) says, so that nothing that belongs together is cut."""
    held, rows, wanted = [], 0, size
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            end = ends(table)
            if end:
                yield table.slice(0, end), True
                table = table.slice(end)
            held, rows = table.to_batches(), table.num_rows
            wanted = max(size, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks(), False


def numbers(table: pa.Table, name: str, null: bool | int | None = None) -> np.ndarray:
    """A column; `null` for null, else NaN."""
    column = table.column(name).combine_chunks()
    return (column if null is None else column.fill_null(null)).to_numpy(zero_copy_only=False)


def beginnings(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns is not as in the row before; the first is one."""
    n = len(columns[0])
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if n else np.empty(0, np.int64)


def codes(table: pa.Table, *names: str) -> np.ndarray:
    """The number of each row's run of equal values."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        own = table.column(name).combine_chunks().dictionary_encode()
        own = own.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= own[1:] != own[:-1]
    return np.cumsum(out)


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `counts` each, in one array."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def mutual_best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) from best to worst, those that are taken greedily, each a and each b once.

    A pair that is the best of both its sides is taken whatever else is there; so all such go in one round.
    """
    left, found = np.arange(len(a)), []
    first_a, first_b = (np.zeros(s.max(initial=-1) + 1, np.int64) for s in (a, b))
    gone_a, gone_b = np.zeros(len(first_a), bool), np.zeros(len(first_b), bool)
    while len(left):
        first_a[a[left][::-1]] = left[::-1]
        first_b[b[left][::-1]] = left[::-1]
        best = left[(first_a[a[left]] == left) & (first_b[b[left]] == left)]
        found.append(best)
        gone_a[a[best]] = gone_b[b[best]] = True
        left = left[~(gone_a[a[left]] | gone_b[b[left]])]
    return np.concatenate(found) if found else left


def summed(rows: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's `sum` makes them, with the lost parts kept."""
    total, lost = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    for v in rows:
        whole = total + v
        lost += np.where(np.abs(total) >= np.abs(v), (total - whole) + v, (v - whole) + total)
        total = whole
    return np.where(np.isfinite(lost), total + lost, total)


class Lockstep:
    """Tracks of many videos as columns of one matrix, in the order in which they began."""

    def __init__(self, config: Config = Config()):
        self.config, self.n_areas = config, min(config.area_points or config.max_positions, config.max_positions)
        self.state, self.owner, self.n = np.empty((AREAS + self.n_areas, 1024)), np.empty(1024, np.int64), 0
        self.next_id = np.ones(0, np.int64)
        self.load(np.empty((3, 0)))

    def load(self, boxes: np.ndarray) -> None:
        """The boxes of the coming steps: centre x, y and area."""
        self.boxes, self.free = boxes, np.ones(boxes.shape[1], bool)

    def tracks_of(self, video: int) -> np.ndarray:
        return self.state[:, : self.n][:, self.owner[: self.n] == video]

    def resume(self, tracks: np.ndarray, next_id: np.ndarray) -> None:
        """Go on with these tracks, of the first video."""
        self.n, self.next_id = 0, next_id
        self._reserve(tracks.shape[1])
        self.n = tracks.shape[1]
        self.state[:, : self.n], self.owner[: self.n] = tracks, 0

    def _reserve(self, need: int) -> None:
        if need > len(self.owner):
            room = max(need, 2 * len(self.owner)) - len(self.owner)
            self.state, self.owner = np.pad(self.state, ((0, 0), (0, room))), np.pad(self.owner, (0, room))

    def _keep(self, kept: np.ndarray) -> None:
        m = len(kept)
        self.state[:, :m], self.owner[:m], self.n = self.state[:, kept], self.owner[kept], m

    def _sized(self, slots: np.ndarray) -> None:
        """The mean area and the radius that follow from the last areas."""
        s, c = self.state, self.config
        s[MEAN, slots] = summed(s[AREAS:, slots]) / np.minimum(s[AGE, slots], self.n_areas)
        s[RADIUS, slots] = np.fmax(c.min_radius, np.sqrt(np.fmax(0.0, s[MEAN, slots])) * c.radius_scale)

    def _begin(self, video: np.ndarray, x: np.ndarray, y: np.ndarray, area: np.ndarray, t: np.ndarray) -> np.ndarray:
        need = self.n + len(video)
        self._reserve(need)
        slots, c = np.arange(self.n, need), self.config
        s = self.state
        s[:, self.n : need] = 0.0
        for row, v in ((X, x), (Y, y), (PLACE, c.initial_position**2), (SPEED, c.initial_velocity**2), (T, t), (SEEN, t), (AGE, 1), (ID, self.next_id[video]), (-1, area)):
            s[row, slots] = v
        self.owner[self.n : need], self.n = video, need
        self.next_id[video] += 1
        self._sized(slots)
        return slots

    def _update(self, slots: np.ndarray, x: np.ndarray, y: np.ndarray, area: np.ndarray, t: np.ndarray) -> None:
        s, c = self.state, self.config
        own = s[:AREAS, slots]
        seen = own[PLACE] + c.measurement_noise**2
        ok = seen * seen > 1e-10
        seen = np.where(ok, seen, 1.0)
        k_place, k_speed = np.where(ok, own[PLACE] / seen, 0.0), np.where(ok, own[MIXED] / seen, 0.0)
        dx, dy = x - own[X], y - own[Y]
        for row, v in ((X, k_place * dx), (Y, k_place * dy), (VX, k_speed * dx), (VY, k_speed * dy), (SPEED, -(k_speed * own[MIXED])), (MIXED, -(k_place * own[MIXED])), (PLACE, -(k_place * own[PLACE]))):
            s[row, slots] = own[row] + np.where(ok, v, 0.0)
        s[T, slots] = s[SEEN, slots] = t
        s[AGE, slots] = np.minimum(own[AGE] + 1, c.max_positions)
        s[AREAS:-1, slots] = s[AREAS + 1 :, slots]
        s[-1, slots] = area
        self._sized(slots)

    def _predict(self, now: np.ndarray) -> None:
        s, c = self.state[:, : self.n], self.config
        dt = now - s[T]
        still = np.flatnonzero(dt <= 0)
        kept = s[:SEEN, still]
        s[X] += s[VX] * dt
        s[Y] += s[VY] * dt
        s[T] = now
        s[PLACE] += 2 * dt * s[MIXED] + dt * dt * s[SPEED] + c.position_noise
        s[MIXED] += dt * s[SPEED]
        s[SPEED] += c.velocity_noise
        s[:SEEN, still] = kept

    def _near(self, slots: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the slots have (x, y) in their radius, and how far off."""
        s = self.state
        dx, dy, radius = (x - s[X, slots], y - s[Y, slots], s[RADIUS, slots])
        at = np.flatnonzero((np.abs(dx) <= radius) & (np.abs(dy) <= radius))
        away = np.hypot(dx[at], dy[at])
        within = away <= radius[at]
        return at[within], away[within]

    def step(self, t: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take one frame of each video: its time and its boxes, `count` of those loaded from `start` on; none for a video that is over.

        Gives boxes that joined or began a track, and their tracks' slots, which hold until the next step.
        """
        gone = np.isnan(self.state[X, : self.n]) | (count[self.owner[: self.n]] == 0)
        if 4 * np.count_nonzero(gone) > self.n:
            self._keep(np.flatnonzero(~gone))
        owner, boxes = self.owner[: self.n], self.boxes
        self._predict(t[owner])
        theirs, most = count[owner], int(count.max(initial=0))
        pairs = []
        for b in range(most):
            slots = np.flatnonzero(theirs > b)
            box = start[owner[slots]] + b
            at, away = self._near(slots, boxes[0, box], boxes[1, box])
            pairs.append((slots[at], box[at], away))
        slot, box, away = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((slot, box, away))
        slot, box = slot[order], box[order]
        taken = mutual_best(slot, np.unique(box, return_inverse=True)[1])
        slot, box = slot[taken], box[taken]
        self._update(slot, *boxes[:, box], t[owner[slot]])
        self.free[box] = False
        joined, strong = [(box, slot)], None
        for b in range(most):
            videos = np.flatnonzero(count > b)
            videos = videos[self.free[start[videos] + b]]
            if not len(videos):
                continue
            if strong is None or self.config.strong_age <= 1:
                strong = np.flatnonzero(self.state[AGE, : self.n] >= self.config.strong_age)
            need = np.zeros(len(count), bool)
            need[videos] = True
            old = strong[need[self.owner[strong]]]
            at = start[self.owner[old]] + b
            need[self.owner[old[self._near(old, boxes[0, at], boxes[1, at])[0]]]] = False
            videos = videos[need[videos]]
            at = start[videos] + b
            joined.append((at, self._begin(videos, *boxes[:, at], t[videos])))
        stale = np.flatnonzero(~(t[self.owner[: self.n]] - self.state[SEEN, : self.n] <= self.config.stale_sec))
        self.state[X, stale], self.state[AGE, stale] = np.nan, 0
        return tuple(np.concatenate(x) for x in zip(*joined, strict=True))

    def strides(self, n: int) -> np.ndarray:
        """Frames that each of n videos goes on by after a frame with boxes, as `Tracker.stride`."""
        out = np.full(n, 3)
        out[self.owner[: self.n][self.state[AGE, : self.n] >= 3]] = 2
        return out


def tracked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, config: Config = Config(), stride: bool = False, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Points of tracks of rows that come sorted by video_id, t, frame_idx and det_idx; `stateful.followed` for all videos."""

    def last_frame(table: pa.Table) -> int:
        return int(beginnings(codes(table, "video_id"), numbers(table, "t"), numbers(table, "frame_idx"))[-1])

    machine, open_video, carried = Lockstep(config), None, None
    for table, more in portions(batches, last_frame, size):
        video, t, frame = codes(table, "video_id"), numbers(table, "t"), numbers(table, "frame_idx")
        x, y, w, h = (numbers(table, c) for c in "xywh")
        boxes = np.array([x + w / 2, y + h / 2, w * h])
        machine.load(boxes)
        starts = beginnings(video, t, frame)
        ends, n, names = np.append(starts[1:], len(t)), int(video[-1]) + 1, table.column("video_id")
        lead = np.searchsorted(video[starts], np.arange(n + 1))
        at, stop = lead[:-1].copy(), lead[1:]
        reach = np.concatenate([np.maximum.accumulate(frame[starts[a:b]]) for a, b in zip(at, stop, strict=True)])
        wanted, tracks, next_id = np.full(n, -np.inf), np.empty((len(machine.state), 0)), np.ones(n, np.int64)
        if carried is not None and names[0].as_py() == open_video:
            tracks, next_id[0], high, wanted[0] = carried
            reach[: stop[0]] = np.maximum(reach[: stop[0]], high)
        machine.resume(tracks, next_id)
        found, made, left = [], [], None
        while True:
            if stride:
                while len(skip := np.flatnonzero((at < stop) & (reach[np.minimum(at, len(reach) - 1)] < wanted))):
                    at[skip] += 1
            live = at < stop
            if more and left is None and not live[-1]:
                left = machine.tracks_of(n - 1)  # as the video goes on in the next portion
            if not live.any():
                break
            own = np.minimum(at, len(starts) - 1)
            box, slot = machine.step(np.where(live, t[starts[own]], np.nan), starts[own], np.where(live, ends[own] - starts[own], 0))
            found.append(box)
            made.append(machine.state[:AREAS, slot])
            if stride:
                wanted = np.where(live, frame[starts[own]] + machine.strides(n), wanted)
            at = at + live
        open_video, carried = names[-1].as_py(), (left, machine.next_id[-1], reach[-1], wanted[-1]) if more else None
        if not found:
            continue
        row, state = np.concatenate(found), np.concatenate(made, axis=1)
        picked = table.take(pa.array(row))
        values = {"track_id": state[ID].astype(np.int64), "age": state[AGE].astype(np.int32), "x": state[X], "y": state[Y], "raw_x": boxes[0, row], "raw_y": boxes[1, row], "vx": state[VX], "vy": state[VY], "mean_area": state[MEAN], "radius": state[RADIUS]}
        out = pa.table([pa.array(values[f.name]) if f.name in values else picked.column(f.name).cast(f.type) for f in schema], schema=schema)
        yield from out.to_batches(max_chunksize=10_000)
