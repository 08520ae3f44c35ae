"""The numbers that the gate judges by, over the trailing windows of sorted track points, by arrays.

The same as the columns of `gate` over arrays of points, without an array per row: windows are places
in the rows, and one step takes the next point of many windows.  Sums are made in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import lockstep
from .config import Config

TRAITS = "points_n int, inconsistency double, acceleration double, smoothness double, vertical double, span double, jump double, off_path double, has_fit boolean, fit_a double, fit_r2 double, span_y double, moving boolean, loops boolean"
#: Of a window with too few points for any measure.
NOTHING = {"inconsistency": 1.0, "off_path": -1.0, "fit_a": np.nan, "fit_r2": np.nan}
#: Points of windows that are laid out at once.
CELLS = 1 << 19


def _fit(t: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether there is a fit, a, b, c and r2 of y over t (from 0 on) of the first n points; a row is a place in the window."""
    s1, s2, s3, s4, y0, y1, y2 = (np.zeros(len(n)) for _ in range(7))
    for k in range(len(t)):
        own = np.flatnonzero(n > k)
        u, v = t[k, own], y[k, own]
        for total, term in ((s1, u), (s2, u * u), (s3, u * u * u), (s4, u * u * u * u), (y0, v), (y1, u * v), (y2, u * u * v)):
            total[own] += term
    m = n.astype(float)
    det = s4 * (s2 * m - s1 * s1) - s3 * (s3 * m - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (y2 * (s2 * m - s1 * s1) - s3 * (y1 * m - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / det
    b = (s4 * (y1 * m - y0 * s1) - y2 * (s3 * m - s1 * s2) + s2 * (s3 * y0 - y1 * s2)) / det
    c = (s4 * (s2 * y0 - s1 * y1) - s3 * (s3 * y0 - s2 * y1) + y2 * (s3 * s1 - s2 * s2)) / det
    middle, rest, whole = y0 / m, np.zeros(len(n)), np.zeros(len(n))
    for k in range(len(t)):
        own = np.flatnonzero(n > k)
        u, v = t[k, own], y[k, own]
        off, spread = v - (a[own] * u * u + b[own] * u + c[own]), v - middle[own]
        rest[own] += off * off
        whole[own] += spread * spread
    return (n >= 3) & (np.abs(det) > 1e-18), a, b, c, np.where(whole == 0, np.nan, 1 - rest / whole)


class _Moments:
    """Count, mean and variance of values that come one after another, as `numeric.moments`."""

    def __init__(self, size: int):
        self.n, self.mean, self.m2 = np.zeros(size), np.zeros(size), np.zeros(size)

    def add(self, own: np.ndarray, values: np.ndarray) -> None:
        self.n[own] += 1
        gap = values - self.mean[own]
        mean = self.mean[own] + gap / self.n[own]
        self.m2[own] += gap * (values - mean)
        self.mean[own] = mean

    def spread(self) -> np.ndarray:
        return np.sqrt(np.where(self.n > 0, self.m2 / self.n, 0.0))


def _laid(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row per place in the window; the last point is repeated."""
    return values[start + np.minimum(np.arange(n.max())[:, None], n - 1)]


def _traits(t: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, n: np.ndarray, loop_start: np.ndarray, loop_n: np.ndarray, config: Config) -> dict[str, np.ndarray]:
    c, size = config, len(n)
    at, px, py = _laid(t, start, n), _laid(x, start, n), _laid(y, start, n)
    end = n - 1, np.arange(size)
    span = at[end] - at[0]
    flat = span <= 0
    timed = np.where(flat, np.arange(len(at))[:, None] / 30.0, at)
    from_0 = timed - timed[0]
    has_fit, a, _, _, r2 = _fit(from_0, py, n)
    has_before, a1, b1, c1, _ = _fit(from_0[: len(at) - 1], py[: len(at) - 1], n - 1)
    last = from_0[end]
    off_path = np.where((n >= 5) & has_before, np.abs(a1 * last * last + b1 * last + c1 - py[end]), -1.0)

    speeds, angles, fastest, turns = _Moments(size), _Moments(size), np.zeros(size), np.zeros(size, bool)
    dx, dy, dt = np.diff(px, axis=0), np.diff(py, axis=0), np.diff(at, axis=0)
    length, v = np.sqrt(dx * dx + dy * dy), dy / np.maximum(1e-3, np.diff(timed, axis=0))
    for k in range(1, len(at)):
        own = np.flatnonzero((n > k) & (dt[k - 1] > 0))
        speeds.add(own, np.hypot(dx[k - 1, own], dy[k - 1, own]) / dt[k - 1, own])
        own = np.flatnonzero(n > k)
        fastest[own] = np.maximum(fastest[own], np.abs(v[k - 1, own]))
        if k > 1:
            turns[own] |= v[k - 1, own] * v[k - 2, own] < 0
            own = own[(length[k - 1, own] > 0.001) & (length[k - 2, own] > 0.001)]
            cosine = (dx[k - 2, own] * dx[k - 1, own] + dy[k - 2, own] * dy[k - 1, own]) / (length[k - 2, own] * length[k - 1, own])
            angles.add(own, np.arccos(np.clip(cosine, -1, 1)))
    share = np.where(np.isnan(r2), 1.0, np.clip(r2, 0, 1))
    pull = np.where(has_fit & ~flat & (n >= 4), np.minimum(1.0, np.abs(a) / max(1e-6, c.gravity_curvature)) * share, 0.0)
    unsteady = np.where((n >= 3) & (speeds.mean > 0), np.minimum(1.0, speeds.spread() / speeds.mean), 1.0)
    smooth = np.where(n < 3, 0.0, np.where(angles.n == 0, 1.0, np.maximum(0.0, 1 - np.minimum(1.0, angles.mean / math.pi))))
    net, rise = np.hypot(px[end] - px[0], py[end] - py[0]), np.abs(py[end] - py[0])
    vertical = np.where(net > 0.001, np.minimum(1.0, rise / net * 2), 0.0)
    span_y = py.max(axis=0) - py.min(axis=0)
    before = np.maximum(n - 2, 0), np.arange(size)
    lx = _laid(x, loop_start, loop_n)
    excursion, back = lx.max(axis=0) - lx.min(axis=0), np.abs(lx[loop_n - 1, np.arange(size)] - lx[0])
    known = n >= c.type_min_points
    return {
        "inconsistency": np.where(known, unsteady, 1.0),
        **{name: np.where(known, values, 0.0) for name, values in (("acceleration", pull), ("smoothness", smooth), ("vertical", vertical), ("span", span))},
        "jump": np.hypot(px[end] - px[before], py[end] - py[before]),
        "off_path": off_path,
        "has_fit": has_fit,
        "fit_a": a,
        "fit_r2": r2,
        "span_y": span_y,
        "moving": (fastest >= c.min_speed) | (turns & (span_y >= c.min_span_y)),
        "loops": c.reject_loops & (loop_n >= 4) & (excursion >= c.loop_min_excursion) & (back <= excursion * c.loop_return_ratio),
    }


def traits(track: np.ndarray, tick: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, config: Config) -> dict[str, np.ndarray]:
    """TRAITS of rows from `first` on; rows are sorted by track, tick and t, and those before `first` are looked at only."""
    spans = round(max(0.1, config.window_sec) * 600), round(config.loop_window_sec * 600)
    tick = tick - tick.min()
    key = track * (int(tick.max()) + max(spans) + 1) + tick
    lead, own = np.searchsorted(track, track[first:]), np.arange(first, len(track))
    end = np.searchsorted(key, key[own], "right")
    start, loop_start = (np.maximum(lead, np.searchsorted(key, key[own] - span)) for span in spans)
    n = end - start
    schema = lockstep.arrow_schema(TRAITS)
    out = {f.name: np.full(len(n), NOTHING.get(f.name, 0), f.type.to_pandas_dtype()) for f in schema}
    out["points_n"] = n.astype(np.int32)
    rows = np.flatnonzero(n >= min(config.min_points, config.type_min_points))
    rows = rows[np.argsort(-n[rows], kind="stable")]
    while len(rows):
        fit = max(1, CELLS // int(n[rows[0]]))
        now, rows = rows[:fit], rows[fit:]
        with np.errstate(all="ignore"):
            found = _traits(t, x, y, start[now], n[now], loop_start[now], (end - loop_start)[now], config)
        for name, values in found.items():
            out[name][now] = values
    return out


def judged_by(batches: Iterator[pa.RecordBatch], config: Config, size: int = lockstep.PORTION) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by video_id, track_id, tick and t, with TRAITS; `tick` goes."""
    keys, reach = ("video_id", "track_id"), round(max(0.1, config.window_sec, config.loop_window_sec) * 600)

    def last_tick(table: pa.Table) -> int:
        return int(lockstep.beginnings(lockstep.codes(table, *keys), lockstep.numbers(table, "tick"))[-1])

    earlier, schema = None, lockstep.arrow_schema(TRAITS)
    for own, more in lockstep.portions(batches, last_tick, size):
        table = own if earlier is None else pa.concat_tables([earlier, own]).combine_chunks()
        first = table.num_rows - own.num_rows
        track, tick = lockstep.codes(table, *keys), lockstep.numbers(table, "tick")
        found = traits(track, tick, *(lockstep.numbers(table, c) for c in ("t", "x", "y")), first, config)
        out = own.drop_columns(["tick"])
        for f in schema:
            out = out.append_column(f, pa.array(found[f.name]))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)
        kept = int(np.flatnonzero((track == track[-1]) & (tick >= tick[-1] - reach))[0])
        earlier = table.slice(kept) if more else None
