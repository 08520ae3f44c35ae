"""Arithmetic that is defined everywhere, fits, and scores of motion, as columns.

A point is a struct of t, x and y (doubles); a trajectory is an array of points in
the order of t.  Undefined ratios are NaN, never an error and never null, and every
comparison with one is guarded, since Spark orders NaN above all numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def d(value: float | Column) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or `otherwise` where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(float(otherwise)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def at_least(x: Column, limit: float | Column) -> Column:
    """x >= limit, false for NaN."""
    return ~F.isnan(x) & (x >= limit)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where it holds array functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column, otherwise: float = 0.0) -> Column:
    return ratio(total(values), d(F.size(values)), otherwise)


def moments(values: Column) -> Column:
    """struct(n, mean, var) in one pass; var is that of the population; zeros for an empty array."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "m2")])

    def add(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        gap = v - a["mean"]
        m = a["mean"] + gap / n
        return F.struct(n.alias("n"), m.alias("mean"), (a["m2"] + gap * (v - m)).alias("m2"))

    return F.aggregate(values, zero, add, lambda a: F.struct(a["n"].alias("n"), a["mean"].alias("mean"), F.when(a["n"] > 0, a["m2"] / a["n"]).otherwise(F.lit(0.0)).alias("var")))


def steps(points: Column, make) -> Column:
    """make(before, after) for neighbouring points."""
    n = F.size(points)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: make(F.get(points, i - 1), F.get(points, i)))).otherwise(F.array().cast("array<double>"))


# ------------------------------------------------------------------ fits

def solve_quadratic(n: Column, sums: list[Column], ys: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Least squares y = a t^2 + b t + c by determinants from power sums s1..s4 and sums of y, ty, t^2 y.

    Returns a, b, c and the determinant; a fit exists where the latter is not 0.
    """
    s1, s2, s3, s4 = sums
    y0, y1, y2 = ys
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    da = y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)
    db = s4 * (y1 * n - y0 * s1) - y2 * (s3 * n - s1 * s2) + s2 * (s3 * y0 - y1 * s2)
    dc = s4 * (s2 * y0 - s1 * y1) - s3 * (s3 * y0 - s2 * y1) + y2 * (s3 * s1 - s2 * s2)
    return da, db, dc, det


def quadratic_fit(points: Column) -> Column:
    """struct(a, b, c, r2) of y over t minus the first t; null below three points or without a unique fit.

    r2 is NaN where y never changes.
    """
    first = F.get(points, F.lit(0))["t"]
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("s1", "s2", "s3", "s4", "y0", "y1", "y2")])

    def add(a: Column, p: Column) -> Column:
        t = p["t"] - first
        return F.struct((a["s1"] + t).alias("s1"), (a["s2"] + t * t).alias("s2"), (a["s3"] + t * t * t).alias("s3"), (a["s4"] + t * t * t * t).alias("s4"), (a["y0"] + p["y"]).alias("y0"), (a["y1"] + t * p["y"]).alias("y1"), (a["y2"] + t * t * p["y"]).alias("y2"))

    def finish(s: Column) -> Column:
        n = d(F.size(points))
        a, b, c, det = solve_quadratic(n, [s[k] for k in ("s1", "s2", "s3", "s4")], [s[k] for k in ("y0", "y1", "y2")])
        exists = (n >= 3) & (F.abs(det) > 1e-18)
        return F.when(exists, F.struct((a / det).alias("a"), (b / det).alias("b"), (c / det).alias("c"), (s["y0"] / n).alias("m"), first.alias("t0")))

    fit = F.aggregate(points, zero, add, finish)
    def judge(f: Column) -> Column:
        zeros = F.struct(F.lit(0.0).alias("res"), F.lit(0.0).alias("tot"))

        def add_squares(acc: Column, p: Column) -> Column:
            t = p["t"] - f["t0"]
            off, spread = p["y"] - (f["a"] * t * t + f["b"] * t + f["c"]), p["y"] - f["m"]
            return F.struct((acc["res"] + off * off).alias("res"), (acc["tot"] + spread * spread).alias("tot"))

        r2 = F.aggregate(points, zeros, add_squares, lambda s: F.when(s["tot"] == 0, nan()).otherwise(1 - s["res"] / s["tot"]))
        return F.when(f.isNotNull(), F.struct(f["a"].alias("a"), f["b"].alias("b"), f["c"].alias("c"), r2.alias("r2")))

    return let(fit, judge)


def line_slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, least: int = 3) -> Column:
    """Slope of the least-squares line from sums; null below `least` points or where x never changes."""
    det = n * sxx - sx * sx
    return F.when((n >= least) & (F.abs(det) > 1e-12), (n * sxy - sx * sy) / det)


# ------------------------------------------------------------------ coefficients of variation, four kinds

def speeds(points: Column) -> Column:
    """Distance over time of the steps that take time."""
    each = steps(points, lambda p, q: F.when(q["t"] > p["t"], F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / (q["t"] - p["t"])))
    return F.filter(each, lambda v: v.isNotNull())


def cv_capped(values: Column) -> Column:
    """Of speeds: 1 without a positive mean, at most 1."""
    return let(moments(values), lambda m: F.when(m["mean"] > 0, F.least(F.lit(1.0), F.sqrt(m["var"]) / m["mean"])).otherwise(F.lit(1.0)))


def cv_open(values: Column) -> Column:
    """0 below two values, 1 without a positive mean, uncapped."""
    return let(moments(values), lambda m: F.when(m["n"] < 2, F.lit(0.0)).when(m["mean"] > 0, F.sqrt(m["var"]) / m["mean"]).otherwise(F.lit(1.0)))


def steadiness(values: Column) -> Column:
    """1 - cv of the finite positive values, within 0 and 1; 0 below two."""
    usable = F.filter(values, lambda v: ~F.isnan(v) & (v > 0) & (v < float("inf")))
    return let(moments(usable), lambda m: F.when(m["n"] >= 2, clamp(1 - F.sqrt(m["var"]) / m["mean"])).otherwise(F.lit(0.0)))


def size_dynamics(values: Column, reference: float = 0.25) -> Column:
    """cv over a reference, at most 1; 0 below three values."""
    return let(moments(values), lambda m: F.when((m["n"] >= 3) & (m["mean"] > 1e-9), F.least(F.lit(1.0), F.sqrt(m["var"]) / m["mean"] / reference)).otherwise(F.lit(0.0)))


# ------------------------------------------------------------------ shape of motion

def turning_smoothness(points: Column) -> Column:
    """1 - mean turning angle / pi; 0 below three points, 1 if no step is long enough to have a direction."""
    n = F.size(points)

    def angle(i: Column) -> Column:
        p, q, r = F.get(points, i - 2), F.get(points, i - 1), F.get(points, i)
        ax, ay, bx, by = q["x"] - p["x"], q["y"] - p["y"], r["x"] - q["x"], r["y"] - q["y"]
        la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
        return F.when((la > 0.001) & (lb > 0.001), F.acos(clamp((ax * bx + ay * by) / (la * lb), -1, 1)))

    angles = F.filter(F.transform(F.sequence(F.lit(2), n - 1), angle), lambda v: v.isNotNull())
    smooth = let(moments(angles), lambda m: F.when(m["n"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), m["mean"] / math.pi))))
    return F.when(n < 3, F.lit(0.0)).otherwise(smooth)


def vertical_score(points: Column) -> Column:
    """Twice the vertical share of the net displacement, at most 1; 0 without displacement."""
    p, q = F.get(points, F.lit(0)), F.element_at(points, -1)
    net = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    return F.when((F.size(points) > 0) & (net > 0.001), F.least(F.lit(1.0), F.abs(q["y"] - p["y"]) / net * 2)).otherwise(F.lit(0.0))


def vertical_ratio(points: Column) -> Column:
    """Vertical share of the path length; 0 for a path without length."""
    return ratio(total(steps(points, lambda p, q: F.abs(q["y"] - p["y"]))), total(steps(points, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))


def acceleration_smoothness(points: Column, reference: float = 1000.0) -> Column:
    """1 - spread of the acceleration's size over a reference, at least 0; 0 without accelerations."""
    n = F.size(points)

    def acceleration(i: Column) -> Column:
        p, q, r = F.get(points, i - 2), F.get(points, i - 1), F.get(points, i)
        t1, t2 = q["t"] - p["t"], r["t"] - q["t"]
        half = (t1 + t2) / 2
        return F.when((t1 > 0) & (t2 > 0), F.hypot((r["x"] - q["x"]) / t2 - (q["x"] - p["x"]) / t1, (r["y"] - q["y"]) / t2 - (q["y"] - p["y"]) / t1) / half)

    found = F.filter(F.transform(F.sequence(F.lit(2), n - 1), acceleration), lambda v: v.isNotNull())
    smooth = let(moments(found), lambda m: F.when(m["n"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(m["var"]) / reference)))
    return F.when(n < 3, F.lit(0.0)).otherwise(smooth)


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of two intervals; 0 where the union has no length."""
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = F.greatest(F.lit(0.0), e1 - s1) + F.greatest(F.lit(0.0), e2 - s2) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Of two boxes, structs of x, y, w and h."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    shared = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def upright_size(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Size of the box around a w by h box that is turned."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return w * c + h * s, w * s + h * c


def cover_scale(w: Column, h: Column, degrees: Column) -> Column:
    """Scale at which a turned w by h picture still covers w by h."""
    bw, bh = upright_size(w, h, degrees)
    return F.greatest(ratio(bw, w, 1.0), ratio(bh, h, 1.0))


def level(x: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first cut that x reaches; a NaN or null gets the last."""
    out = F
    for limit, name in cuts:
        out = out.when(at_least(x, limit), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def quality_level(x: Column) -> Column:
    """Above 1 is poor, as nothing valid is."""
    return F.when(x > 1, F.lit("poor")).otherwise(level(x, [(0.9, "excellent"), (0.7, "good"), (0.5, "acceptable")], "poor"))


def performance_level(overhead_percent: Column, fps: Column) -> Column:
    """The worse of what the overhead and the rate allow."""
    allowed = [("poor", 15, 15), ("fair", 8, 25), ("good", 5, 35)]
    out = F
    for name, most, least in allowed:
        out = out.when((overhead_percent > most) | (fps < least), F.lit(name))
    return out.otherwise(F.lit("excellent"))


def poll_percent(votes: Column, total_votes: Column) -> Column:
    """Whole percent, cut off; 0 without votes."""
    return F.when(total_votes > 0, F.floor(votes.cast("double") / total_votes * 100)).otherwise(F.lit(0)).cast("int")
