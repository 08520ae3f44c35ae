import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.functions import numeric as N
from trackloom.operators import detections as D
from trackloom.operators import evaluate as E
from trackloom.operators import gate, intervals, lockstep, replays, selection, stateful, windows
from trackloom.operators import metrics as M
from trackloom.operators.config import Config
from trackloom.operators import court as K
from trackloom.operators import decider as P
from trackloom.operators import timejoin as T
from trackloom.operators.decider import Decider
from trackloom.operators.kernels import Selector, Tracker

C = Config()


def trajectory(spark, rows):
    """rows: (key, [(t, x, y)])."""
    return spark.createDataFrame(rows, "key string, points array<struct<t:double,x:double,y:double>>")


PARABOLA = [(0.05 * k, 0.4 * (0.05 * k) + 0.3, -0.5 * (0.4 * 0.05 * k + 0.3) ** 2 + 0.5 * (0.4 * 0.05 * k + 0.3) + 0.3) for k in range(20)]
SERVE = [(t, min(0.9, 0.15 + 0.5 * t), max(0.1, min(0.9, 0.85 - 0.15 * t - 0.55 * t * t))) for t in (0.033 * k for k in range(30))]
LINE = [(0.05 * k, 0.2 + 0.4 * 0.05 * k, 0.5) for k in range(20)]
ZIGZAG = [(0.1 * k, 0.3, 0.5 + (0.2 if k % 2 else -0.2) * (1 + k % 3)) for k in range(20)]


def test_quadratic_fit(spark):
    rnd = random.Random(1)
    noisy = [(5 + 0.1 * k, 0.0, 0.3 * k - 0.02 * k * k + rnd.random() / 9) for k in range(15)]
    rows = [("noisy", noisy), ("flat", LINE), ("few", LINE[:2]), ("still", [(1.0, 0.0, 2.0)] * 5), ("none", [])]
    got = {r.key: r.f for r in trajectory(spark, rows).select("key", N.quadratic_fit(F.col("points")).alias("f")).collect()}
    t, y = np.array([p[0] - 5 for p in noisy]), np.array([p[2] for p in noisy])
    want = np.polyfit(t, y, 2)
    assert np.allclose([got["noisy"].a, got["noisy"].b, got["noisy"].c], want, rtol=1e-9)
    assert got["noisy"].r2 == pytest.approx(1 - ((np.polyval(want, t) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert math.isnan(got["flat"].r2) or got["flat"].a == pytest.approx(0, abs=1e-9)
    assert got["few"] is None and got["still"] is None and got["none"] is None


def test_coefficients_of_variation_differ(spark):
    rows = [([],), ([0.0, 0.0],), ([5.0],), ([1.0, 3.0],), ([1.0, 2.0, 30.0],), ([float("nan"), 1.0, 2.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [tuple(r) for r in df.select(N.cv_capped(F.col("v")), N.cv_open(F.col("v")), N.steadiness(F.col("v")), N.size_dynamics(F.col("v"))).collect()]
    big = np.std([1, 2, 30]) / 11
    assert got[0] == (1.0, 0.0, 0.0, 0.0) and got[1] == (1.0, 1.0, 0.0, 0.0) and got[2] == (0.0, 0.0, 0.0, 0.0)
    assert got[3][:3] == (0.5, 0.5, 0.5) and got[4] == (pytest.approx(1.0), pytest.approx(big), 0.0, 1.0)
    assert got[5][2] == pytest.approx(1 - 0.5 / 1.5)


def test_undefined_ratios_never_raise(spark):
    row = spark.range(1).select(N.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), N.at_least(N.nan(), 0.5).alias("b"), N.interval_iou(*[F.lit(1.0)] * 4).alias("c"), N.quality_level(F.lit(1.2)).alias("d"), N.quality_level(F.lit(1.0)).alias("e"), N.performance_level(F.lit(6.0), F.lit(60.0)).alias("f"), N.poll_percent(F.lit(2), F.lit(3)).alias("g")).first()
    assert tuple(row) == (0.0, False, 0.0, "poor", "excellent", "good", 66)


def test_movement_types(spark):
    rows = [("parabola", PARABOLA), ("serve", SERVE), ("zigzag", ZIGZAG), ("few", LINE[:3]), ("none", [])]
    got = {r.key: r for r in gate.classify(trajectory(spark, rows)).collect()}
    assert got["parabola"].movement_type == "airborne" and got["parabola"].inconsistency < 0.3
    assert got["serve"].movement_type == "airborne" and got["serve"].type_confidence > 0.7
    assert got["zigzag"].movement_type == "carried"
    assert got["few"].movement_type == got["none"].movement_type == "unknown" and got["few"].type_confidence == 0


def test_gate_reasons(spark):
    flight = [(k / 30, 0.2 + k * 0.02, 0.3 + 1.2 * (k / 30) - 0.9 * (k / 30) ** 2) for k in range(20)]
    jump = flight[:-1] + [(flight[-1][0], flight[-1][1] + 0.3, flight[-1][2])]
    off = flight[:-1] + [(flight[-1][0], flight[-1][1], flight[-1][2] - 0.09)]
    loop = [(k / 30, 0.4 + 0.1 * math.sin(k / 19 * 2 * math.pi), 0.3 + 1.2 * (k / 30) - 0.9 * (k / 30) ** 2) for k in range(20)]
    rows = [("flight", flight), ("jump", jump), ("off", off), ("few", flight[:3]), ("flat", LINE), ("loop", loop)]
    df = trajectory(spark, rows).withColumn("loop_points", F.col("points"))
    got = {r.key: r for r in gate.validate(df).collect()}
    assert got["flight"].is_valid and got["flight"].gate_confidence == pytest.approx(1)
    assert got["jump"].rejection_reason == "position jump too big" and got["off"].rejection_reason == "off predicted path (ROI)"
    assert got["few"].rejection_reason == "too few points in window" and not got["flat"].is_valid
    assert got["loop"].rejection_reason == "doubling back (loop)"


def flights(seed):
    """Tracks of arcs, lines, loops, stops and noise, with gaps and equal times."""
    rnd, rows = random.Random(seed), []
    for v, track in [(v, k) for v in ("a", "b", None) for k in range(12)]:
        t, kind = rnd.random(), rnd.randrange(6)
        for k in range(rnd.choice([1, 2, 3, 4, 5, 30, 90])):
            t += rnd.choice([1 / 30] * 12 + [0.0, 0.0007, 0.4]) if kind != 5 else 0.0
            s = t % 1.0
            x, y = {0: (0.1 + 0.3 * s, 0.3 + 1.2 * s - 0.9 * s * s), 1: (0.2 + 0.4 * s, 0.5), 2: (0.4 + 0.1 * math.sin(6 * s), 0.3 + 1.2 * s - 0.9 * s * s), 3: (0.5, 0.5), 4: (rnd.random(), rnd.random()), 5: (0.3 + k / 100, 0.5 - k / 70)}[kind]
            rows.append((v, track, t, x + rnd.choice([0, 0, 0.001, 0.02]) * rnd.random(), y, len(rows)))
    return rows


@pytest.mark.parametrize("config", [C, Config(min_r2=0.2, min_curvature=0.0, max_jump=9.0, max_offset_y=9.0, min_points=2, type_min_points=3), Config(y_down=True, reject_loops=False, classify=False, window_sec=1.5)])
def test_windows_equal_arrays_of_points(spark, config):
    """The gate over sorted rows judges as the gate over an array for each point, whatever the portions."""
    schema = "video_id string, track_id long, t double, x double, y double, n long"
    points = spark.createDataFrame([r for seed in range(3) for r in [(*p[:1], p[1] + 100 * seed, *p[2:5], p[5] + 10**6 * seed) for p in flights(seed)]], schema).repartition(5)
    keyed = points.withColumn("track_key", F.concat_ws("/", "video_id", "track_id"))
    names = ["inconsistency", "acceleration", "smoothness", "vertical", "span", "movement_type", "type_confidence", "is_valid", "r2", "gate_confidence", "rejection_reason"]
    want = gate.validate(gate.recent_points(keyed, config, "track_key"), config=config).select("n", *names).toPandas().sort_values("n", ignore_index=True)
    got = stateful.gated(points, config).select("n", *names).toPandas().sort_values("n", ignore_index=True)
    assert want.rejection_reason.nunique() > 4
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=1e-9)
    assert "collect_list" not in stateful.gated(points, config)._jdf.queryExecution().toString()
    rows = points.withColumn("tick", F.round(F.col("t") * 600).cast("long")).toPandas().sort_values(["video_id", "track_id", "t", "x", "y"])
    whole = [pa.Table.from_batches(windows.judged_by(iter(pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=29)), config, size)) for size in (10**6, 1, 40, 333)]
    assert all(x.equals(whole[0]) or x.to_pandas().equals(whole[0].to_pandas()) for x in whole[1:])


def frames(n, ball, flight, start=0.0, y=None):
    return [(start + k / 30, ball, flight, y) for k in range(n)]


def run(rows, config=C):
    machine = Decider(config)
    return [machine.step(*r) for r in rows]


def test_decider():
    assert run(frames(13, True, True))[-1]
    assert not run(frames(120, True, True) + frames(40, False, False, 4.0))[-1]
    slow = Config(min_active_sec=3.0)
    assert run(frames(15, True, True) + frames(30, False, False, 0.5), slow)[-1]
    assert not run(frames(60, True, True) + frames(1, True, False, 3.5) + frames(60, False, False, 3.6))[-1]
    high = frames(60, True, True, y=0.9)
    assert run(high + frames(45, False, False, 2.0))[-1] and not run(high + frames(75, False, False, 2.0))[-1]
    gaps = [(k / 30, True, k % 5 == 0, None) for k in range(30)]
    assert run(gaps)[-1] and not run([(k / 30, True, k % 8 == 0, None) for k in range(30)])[-1]


def test_decider_ends_hard_only():
    """Thin evidence and the plain timeout never end play that the hard end has not."""
    rnd = random.Random(5)
    for _ in range(300):
        rows, t = [], 0.0
        for _ in range(200):
            t += rnd.choice([0.02, 0.033, 0.3])
            rows.append((t, rnd.random() < 0.5, rnd.random() < 0.3, rnd.random()))
        frame = tuple(np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (float, bool, bool, float), strict=True))
        may_start, may_end = P.conditions(P.Memory(), *frame, C)
        gone = np.array([min((t - u for u, ball, *_ in rows[: k + 1] if ball), default=math.inf) for k, (t, *_) in enumerate(rows)])
        quiet = np.array([min((t - u for u, _, flight, _ in rows[: k + 1] if flight), default=math.inf) for k, (t, *_) in enumerate(rows)]) > C.recent_sec
        high = [next((y for _, ball, _, y in reversed(rows[: k + 1]) if ball), 0.0) >= C.sky_y for k in range(len(rows))]
        hard = quiet & (gone >= np.where(high, C.sky_timeout, min(0.8, C.end_timeout)))
        assert (P.switched(frame[0], may_start, may_end, None, C)[0] == P.switched(frame[0], may_start, hard, None, C)[0]).all()


def random_frames(seed, n):
    """(t, ball, flight, height), with stretches that are rich and poor in balls, and runs that fall apart."""
    rnd, rich, t, rows = random.Random(seed), True, 0.0, []
    for _ in range(n):
        t += rnd.choice([0.033, 0.033, 0.1, 0.4])
        rich ^= rnd.random() < 0.06
        ball = rnd.random() < (0.9 if rich else 0.1)
        rows.append((t, ball, ball and rnd.random() < 0.6, rnd.choice([None, 0.5, 0.9]) if ball else None))
    return rows


def by_frames(rows, config):
    """Play by the words of the rules, frame by frame, from the start of the video."""
    out, since = [], None
    for k, (t, *_) in enumerate(rows):
        past = rows[: k + 1]
        gone = lambda c, p=past, t=t: min((t - r[0] for r in p if r[c]), default=math.inf)
        run, missed = None, 0
        for r in past:
            if r[2]:
                run, missed = (r[0] if run is None else run), 0
            elif (missed := missed + 1) > config.grace_frames:
                run = None
        height = next((r[3] for r in reversed(past) if r[1] and r[3] is not None), 0.0)
        if since is None:
            since = t if run is not None and t - run >= config.start_buffer else None
        elif t - since >= config.min_active_sec and gone(2) > config.recent_sec:
            rate = sum(r[1] and r[0] >= t - config.evidence_sec for r in past) / config.evidence_sec
            over = gone(1) >= config.sky_timeout if height >= config.sky_y else gone(1) >= min(0.8, config.end_timeout) or gone(2) > 1.5 and rate < 0.5
            since = None if over else since
        out.append(since is not None)
    return out


@pytest.mark.parametrize("config", [C, Config(grace_frames=1, end_timeout=2.0, start_buffer=0.0, min_active_sec=0.5), C.scaled(3.0)])
def test_decider_for_any_cut(config):
    for seed in range(25):
        rows = random_frames(seed, 150)
        want = by_frames(rows, config)
        assert run(rows, config) == want
        frames, memory, since, got = tuple(np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (float, bool, bool, float), strict=True)), P.Memory(), None, []
        cuts = [0, *sorted(random.Random(seed).sample(range(1, 150), seed % 12)), 150]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(x[a:b] for x in frames)
            may = P.conditions(memory, *own, config)
            active, left = P.switched(own[0], *may, since, config)
            assert P.exits(own[0], *may, config).leave(since, config) == left
            since, memory = left, P.after(memory, P.digest(*own, config), config)
            got += active.tolist()
        assert got == want


def test_decider_over_split_videos(spark):
    rows = [(v, *r) for v in (1, 2, None) for r in random_frames(v or 3, 120)]
    table = spark.createDataFrame([*rows, (1, None, True, True, 0.5)], "video_id long, t double, has_ball boolean, is_projectile boolean, ball_y double").repartition(5)
    want = {(v, r[0]): x for v in (1, 2, None) for r, x in zip(random_frames(v or 3, 120), by_frames(random_frames(v or 3, 120), C), strict=True)}
    for cut in (0.5, 7.0, 1e6):
        got = stateful.decide(table, C, cut=cut).collect()
        assert len(got) == len(want) and {(r.video_id, r.t): r.is_active for r in got} == want
    assert stateful.decide(table.where("t < 0")).collect() == []


def test_neighbouring_spans_are_one_piece(spark):
    """Spans of a video go together until they hold enough rows; play does not hang on how many that is."""
    rows = [(v, *r) for v in (1, 2, None) for r in random_frames(v or 3, 120)]
    table = spark.createDataFrame(rows, "video_id long, t double, has_ball boolean, is_projectile boolean, ball_y double").repartition(5)
    want = {(v, r[0]): x for v in (1, 2, None) for r, x in zip(random_frames(v or 3, 120), by_frames(random_frames(v or 3, 120), C), strict=True)}
    for rows_each in (1, 7, 50, 10**6):
        got = stateful.decide(table, C, cut=0.5, rows_each=rows_each).collect()
        assert len(got) == len(want) and {(r.video_id, r.t): r.is_active for r in got} == want


def activity(spark, *spans, end=20.0, step=0.1):
    rows = [("v", k * step, any(a <= k * step < b - 1e-9 for a, b in spans)) for k in range(round(end / step) + 1)]
    return spark.createDataFrame(rows, "video_id string, t double, is_active boolean"), spark.createDataFrame([("v", end)], "video_id string, duration double")


@pytest.mark.parametrize(
    ("spans", "config", "want"),
    [
        ([(5, 10)], C, [(3.0, 10.5)]),
        ([(5, 7.2)], C, [(4.5, 7.7)]),
        ([(5, 8), (9, 12)], C, [(3.0, 12.5)]),
        ([(5, 6)], C, []),
        ([(0.5, 4), (17, 21)], C, [(0.0, 4.5), (15.0, 20.0)]),
        ([(2, 5), (6, 9), (14, 18)], C, [(0.0, 9.5), (12.0, 18.5)]),
        ([], C, []),
        ([(5, 10)], Config(preroll=0.5, postroll=1.0), [(4.5, 11.0)]),
        ([(5, 10)], Config(preroll=0.0, short_preroll=0.0, postroll=0.0), [(5.0, 10.0)]),
        ([(3, 6), (13, 16)], C, [(1.0, 6.5), (11.0, 16.5)]),
    ],
)
def test_segments(spark, spans, config, want):
    rows, duration = activity(spark, *spans)
    got = intervals.build(rows, duration=duration, config=config).orderBy("seg_idx").collect()
    assert [(pytest.approx(r.start), pytest.approx(r.end)) for r in got] == want


def test_joins_by_time_equal_brute_force(spark):
    rnd = random.Random(2)
    points = [(rnd.choice("ab"), k, rnd.uniform(0, 50)) for k in range(200)]
    spans = [(rnd.choice("ab"), k, s := rnd.uniform(0, 45), s + rnd.uniform(0, 9)) for k in range(30)]
    p = spark.createDataFrame(points, "key string, id long, t double")
    r = spark.createDataFrame(spans, "key string, seg long, start double, end double")
    want = sorted((i, g) for k, i, t in points for q, g, s, e in spans if k == q and s <= t <= e)
    for width in (None, 4.0):
        assert sorted((x.id, x.seg) for x in intervals.in_range(p, r, "key", bin_width=width).collect()) == want
    assert {x.id for x in intervals.in_range(p, r, "key", how="left_semi").collect()} == {i for i, _ in want}
    pairs = sorted((a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and a[2] < b[3] and a[3] > b[2])
    assert sorted((x.seg, x.r_seg) for x in intervals.overlapping(r, r, "key").collect()) == pairs
    rows = spark.createDataFrame([(k, i, t, float(i)) for k, i, t in points if i % 3 == 0], "key string, id long, t double, v double")
    probes = p.where("id % 3 = 1")
    as_of = {x.id: x.v for x in intervals.as_of(probes, rows, "key", "t", "v").collect()}
    for k, i, t in points:
        if i % 3 == 1:
            before = [(u, float(j)) for q, j, u in points if q == k and j % 3 == 0 and u <= t]
            assert as_of[i] == (max(before)[1] if before else None)
    near = {x.id: x.r_id for x in intervals.nearest_within(probes, rows, "key", "t", "id", 0.7, "id").collect()}
    first = {x.id: x.r_id for x in intervals.first_within(probes, rows, "key", "t", "id", 0.7, "id").collect()}
    for k, i, t in points:
        if i % 3 == 1:
            ok = [(abs(u - t), j) for q, j, u in points if q == k and j % 3 == 0 and abs(u - t) <= 0.7]
            assert near.get(i) == (min(ok)[1] if ok else None) and first.get(i) == (min(j for _, j in ok) if ok else None)


def spans_and_points(seed, n=300):
    """A third of all rows are of one video, crowded in one moment; ranges from none to very long, some turned around."""
    rnd = random.Random(seed)
    key = lambda k: "hot" if k % 3 == 0 else rnd.choice(["a", "b", None])
    points = [(key(k), rnd.choice([50.0 + rnd.random(), 100 * rnd.random()]), k) for k in range(n)] + [("a", None, -1)]
    ranges = []
    for k in range(60):
        start = 100 * rnd.random()
        ranges.append((key(k), start, start + rnd.choice([0.0, 0.5, 3.0, 3.0, 80.0, -1.0]), k))
    return points, ranges


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_points_in_ranges_equal_brute_force(spark, how):
    points, ranges = spans_and_points(1)
    p, r = spark.createDataFrame(points, "video_id string, t double, id long"), spark.createDataFrame(ranges, "video_id string, start double, end double, seg long")
    held = {k: [seg for v2, a, b, seg in ranges if v is not None and v == v2 and t is not None and a <= b and a - 0.5 <= t <= b + 0.5] for v, t, k in points}
    want = {"inner": [(k, s) for k, own in held.items() for s in own], "left": [(k, s) for k, own in held.items() for s in own or [None]], "left_semi": [(k, 0) for k, own in held.items() if own], "left_anti": [(k, 0) for k, own in held.items() if not own]}[how]
    for large in (5, 10_000):
        got = [(x.id, x.seg if "seg" in x else 0) for x in T.points_in_ranges(p, r, "video_id", margin=0.5, how=how, large=large).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert T.points_in_ranges(p.where("id < -1"), r, "video_id").count() == 0 and T.points_in_ranges(p, r.where("seg < 0"), "video_id", how="left").count() == len(points)


def test_overlaps_equal_brute_force(spark):
    _, ranges = spans_and_points(2)
    a = spark.createDataFrame([x for x in ranges if x[2] >= x[1]], "video_id string, start double, end double, seg long")
    b = a.select("video_id", (F.col("start") + 0.25).alias("start"), (F.col("end") + 1).alias("end"), "seg")
    for closed in (False, True):
        want = sorted((x.seg, y.seg) for x in a.collect() for y in b.collect() if x.video_id is not None and x.video_id == y.video_id and (x.start <= y.end and x.end >= y.start if closed else x.start < y.end and x.end > y.start))
        assert sorted((x.seg, x.r_seg) for x in T.overlapping(a, b, "video_id", closed).collect()) == want


def test_a_crowded_moment_is_split(spark):
    p = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("video_id"), F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") / 100).alias("t"))
    r = spark.createDataFrame([("hot", 0.0, 100.0)], "video_id string, start double, end double")
    hot = T.hot_bins(p.withColumn("bin", F.floor(F.col("t") / 10)), "video_id", 100).collect()
    assert [(x.hot_key, x.parts) for x in hot] == [("hot", 100)]
    assert T.points_in_ranges(p, r, "video_id", width=10.0, large=100).count() == 10_000


def test_tracker():
    tracker = Tracker()
    box = lambda x, y: (x, y, 0.02, 0.02)
    assert tracker.step(0.1, [box(0.5, 0.5)]) == [(0, 1)] and tracker.tracks[0].age == 1
    assert tracker.step(0.2, [box(0.51, 0.51)]) == [(0, 1)] and tracker.tracks[0].age == 2
    two = Tracker()
    for k in range(3):
        two.step(k / 30, [box(0.2, 0.5), box(0.8, 0.5)])
    assert sorted(two.step(0.1, [box(0.78, 0.5), box(0.22, 0.5)])) == [(0, 2), (1, 1)]
    one = Tracker()
    for k in range(3):
        one.step(k / 30, [box(0.5, 0.5)])
    assert sorted(one.step(0.1, [box(0.55, 0.5), box(0.505, 0.5)])) == [(0, 2), (1, 1)]
    assert one.stride(0.1) == 2 and Tracker().stride(0.0) == 4
    one.step(5.0, [])
    assert one.tracks == []


def test_tracker_equals_the_full_filter():
    """The shared 2 x 2 covariance gives what 4 x 4 matrices give."""
    from trackloom.operators.kernels import Track

    rnd, track = random.Random(3), Track(1, 0.5, 0.5, 0.1, 0.1, 0.0, C)
    state, spread, t = np.array([0.5, 0.5, 0, 0]), np.diag([C.initial_position**2] * 2 + [C.initial_velocity**2] * 2), 0.0
    for _ in range(40):
        dt = rnd.choice([0.03, 0.1])
        t += dt
        z = np.array([rnd.random(), rnd.random()])
        track.predict(t)
        track.update(*z, 0.1, 0.1, t)
        move, see = np.eye(4), np.eye(2, 4)
        move[0, 2] = move[1, 3] = dt
        state, spread = move @ state, move @ spread @ move.T + np.diag([C.position_noise] * 2 + [C.velocity_noise] * 2)
        gain = spread @ see.T @ np.linalg.inv(see @ spread @ see.T + np.eye(2) * C.measurement_noise**2)
        state, spread = state + gain @ (z - see @ state), (np.eye(4) - gain @ see) @ spread
        assert np.allclose([track.x, track.y, track.vx, track.vy], state)


def test_tracks_do_not_depend_on_row_order(spark):
    rows = [("v", k, k / 30, d, 0.1 + 0.3 * d + k * 0.004, 0.3, 0.03, 0.03, 0.9) for k in range(30) for d in range(3)]
    schema = "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double, conf double"
    a = stateful.track(spark.createDataFrame(rows, schema)).collect()
    random.Random(1).shuffle(rows)
    b = stateful.track(spark.createDataFrame(rows, schema).repartition(5)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and {r.track_id for r in a} == {1, 2, 3}


def test_tracker_chooses_its_frames(spark):
    rnd = random.Random(6)
    rows = [("v", k, k / 30, i, x, y, 0.03, 0.03) for k in range(1, 200) if not 80 < k < 150 for i, (x, y) in enumerate([(0.1 + k / 400, 0.3)] + [(rnd.random(), rnd.random())] * (k % 3 == 0))]
    tracker, want, wait = Tracker(C), [], 0
    for k in sorted({r[1] for r in rows}):
        if k < wait:
            continue
        own = [r for r in rows if r[1] == k]
        for b, track_id in tracker.step(k / 30, [(x + w / 2, y + h / 2, w, h) for *_, x, y, w, h in own]):
            want.append((k, own[b][3], track_id))
        wait = k + tracker.stride(k / 30)
    table = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double").repartition(3)
    got = sorted((r.frame_idx, r.det_idx, r.track_id) for r in stateful.track(table, C, stride=True).collect())
    assert got == sorted(want) and len(got) < stateful.track(table, C).count()


def by_selector(points, frames, config):
    """The evidence of one video, frame by frame."""
    chooser, out = Selector(config), []
    for t in sorted(frames):
        last = {}
        for p in sorted((p for p in points if p["t"] <= t <= p["t"] + config.fresh_sec), key=lambda p: p["t"]):
            last[p["track_id"]] = p
        own = [last[k] for k in sorted(last)]
        picked, scores = chooser.step([tuple(p[c] for c in ("track_id", "is_valid", "gate_confidence", "acceleration", "mean_area", "age")) for p in own])
        out.append((t, bool(own), picked is not None, next((p["y"] for p in own if p["track_id"] == picked), own[-1]["y"] if own else None), picked, scores.get(picked)))
    return out


def test_selection_equals_frame_by_frame(spark):
    rnd, frames, points, want = random.Random(11), [], [], []
    for v in [*(f"v{k:02}" for k in range(14)), "long"]:
        times = sorted({round(rnd.random() * (9 if v == "long" else rnd.choice([0.05, 1, 3])), 2) for _ in range(300 if v == "long" else rnd.randrange(1, 60))})
        own = [{"video_id": v, "t": t, "track_id": k, "is_valid": rnd.random() < 0.6, "gate_confidence": rnd.random(), "acceleration": rnd.choice([0.0, 0.5]), "mean_area": 0.01 * rnd.randrange(3), "age": rnd.randrange(20), "y": rnd.random()} for t in times for k in range(6) if rnd.random() < (0.3 if v != "v03" else 0.0)]
        points += own
        times = [t for t in times if rnd.random() < 0.9] + ([] if v == "v05" else [10.0])
        frames += [(v, t) for t in times]
        want += [(v, *r) for r in by_selector(own, times, C)]
    frames.append((None, 1.0))
    want.append((None, 1.0, False, False, None, None, None))
    schema = "video_id string, t double, track_id long, is_valid boolean, gate_confidence double, acceleration double, mean_area double, age int, y double"
    got = stateful.select(spark.createDataFrame(points, schema).repartition(3), spark.createDataFrame([*frames, frames[0]], "video_id string, t double").repartition(4)).collect()
    rounded = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert rounded(got) == rounded(want)
    rows = pd.concat([pd.DataFrame(frames, columns=["video_id", "t"]).assign(is_frame=True), pd.DataFrame(points).assign(is_frame=False)]).sort_values(["video_id", "t", "is_frame", "track_id"])
    for size in (1, 9, 100, 700):
        table = pa.Table.from_pandas(rows.astype({"track_id": "Int64", "is_valid": "boolean"}), preserve_index=False)
        parts = pa.Table.from_batches(selection.chosen(iter(table.to_batches(max_chunksize=13)), C, size)).to_pylist()
        assert rounded([*r.values()] for r in parts) == rounded(want)


def random_boxes(seed, videos=12, frames=90):
    rnd, rows = random.Random(seed), []
    for v in range(videos):
        t = 0.0
        for k in range(1, rnd.randrange(1, frames)):
            t += rnd.choice([0.0, 1 / 30, 1 / 30, 1 / 30, 0.5, 2.5])
            spots = [(0.1 + k / 200, 0.3), (0.1 + k / 200, 0.34), (rnd.random() * 0.3, rnd.random() * 0.3), (0.5, 0.5)]
            own = rnd.sample(spots, rnd.randrange(1, 5))
            rows += [(f"v{v:02}", 2 * k, t, d, x, y, rnd.choice([0.03, 0.05]), 0.03) for d, (x, y) in enumerate(own)]
    return pd.DataFrame(rows, columns=["video_id", "frame_idx", "t", "det_idx", "x", "y", "w", "h"])


@pytest.mark.parametrize("stride", [False, True])
@pytest.mark.parametrize("config", [C, Config(strong_age=1, max_positions=7), Config(area_points=3, stale_sec=0.4)])
def test_videos_in_step_equal_each_alone(config, stride):
    """Many videos advance in one step, in portions of any size, and get what the tracker gives to each by itself."""
    for seed in range(4):
        rows = random_boxes(seed).sort_values(["video_id", "t", "frame_idx", "det_idx"], kind="stable")
        want = pd.concat([stateful.followed(Tracker(config), own, stride) for _, own in rows.groupby("video_id")])
        for size in (1, 50, 300, 10**6):
            batches = pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=37)
            got = pa.Table.from_batches(lockstep.tracked(iter(batches), lockstep.arrow_schema(stateful.TRACK_POINTS), config, stride, size)).to_pandas()
            keys = ["video_id", "frame_idx", "t", "det_idx"]
            pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), check_dtype=False, rtol=0, atol=1e-12)


def test_a_step_takes_a_frame_of_every_video(monkeypatch):
    """The steps are as many as the longest video has frames, not as all have."""
    steps, step = [], lockstep.Lockstep.step
    monkeypatch.setattr(lockstep.Lockstep, "step", lambda self, *a: steps.append(1) or step(self, *a))
    rows = random_boxes(1, videos=40)
    list(lockstep.tracked(iter(pa.Table.from_pandas(rows, preserve_index=False).to_batches()), lockstep.arrow_schema(stateful.TRACK_POINTS), C))
    assert len(steps) == rows.drop_duplicates(["video_id", "frame_idx"]).groupby("video_id").size().max()


def test_selector_sticks():
    s = Selector()
    assert s.step([(1, True, 0.8, 0.8, 0.01, 9), (2, True, 0.7, 0.8, 0.01, 9)])[0] == 1
    assert s.step([(1, True, 0.75, 0.8, 0.01, 9), (2, True, 0.9, 0.8, 0.01, 9)])[0] == 1
    assert s.step([(1, True, 0.4, 0.5, 0.01, 9), (2, True, 0.9, 0.8, 0.01, 9)])[0] == 2
    assert s.step([(1, False, 0.0, None, 0.01, 9)]) == (None, {})


def test_greedy_suppression(spark):
    rnd = random.Random(9)
    rows = [("v", f, f / 30, d, rnd.random() * 0.1, rnd.random() * 0.1, 0.05, 0.05, rnd.random()) for f in range(20) for d in range(8)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double, conf double")

    def iou(a, b):
        w, h = min(a[4], b[4]) + 0.05 - max(a[4], b[4]), min(a[5], b[5]) + 0.05 - max(a[5], b[5])
        s = w * h if w > 0 and h > 0 else 0
        return s / (0.005 - s)

    for got, clash in ((D.dedupe_by_center(df), lambda a, b: math.hypot(a[4] - b[4], a[5] - b[5]) <= 0.02), (D.suppress_overlaps(df), lambda a, b: iou(a, b) >= 0.45)):
        want = set()
        for f in range(20):
            kept = []
            for r in sorted((r for r in rows if r[1] == f), key=lambda r: -r[8]):
                if not any(clash(k, r) for k in kept):
                    kept.append(r)
            want |= {(f, r[3]) for r in kept}
        assert {(r.frame_idx, r.det_idx) for r in got.collect()} == want


def test_static_cells_are_muted(spark):
    rows = [("v", k, k * 0.5, 0, 0.5, 0.5, 0.02, 0.02, 0.9) for k in range(40)] + [("v", k, k * 0.5, 1, 0.01 + k * 0.02, 0.2, 0.02, 0.02, 0.8) for k in range(40)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double, conf double")
    got = D.suppress_static(D.dedupe_by_center(df)).collect()
    assert sum(r.det_idx == 1 for r in got) == 40
    # The first hit counts too, so the eighth is muted; the streak outlives the mute, so the first hit after it is muted again.
    assert sorted(r.frame_idx for r in got if r.det_idx == 0) == list(range(7))


def test_decoding(spark):
    rows = [([0.25, 0.25, 0.5, 0.75, 0.9, 0.0],), ([160.0, 160.0, 320.0, 480.0, 0.9, 0.0],), ([0.5, 0.5, 0.4, 0.6, 0.9, 0.0],), ([0.1, 0.1, 0.2, 0.2, 0.1, 0.0],)]
    got = D.decode(spark.createDataFrame(rows, "raw array<float>"), (640, 640), (640, 640), False, 0.5).collect()
    assert [(r.x, r.y, r.w, r.h) for r in got] == [(0.25, 0.25, 0.25, 0.5)] * 2
    boxed = D.decode(spark.createDataFrame(rows[:1], "raw array<float>"), (640, 640), (1280, 640), True, 0.5).first()
    assert (boxed.x, boxed.y, boxed.w, boxed.h) == (0.25, 0.0, 0.25, 1.0)


def test_court():
    net = (0.1, 0.45, 0.8, 0.1)
    path = [(k, k / 10, [(0.5, 0.3 + 0.04 * k if k < 12 else 0.74 - 0.04 * (k - 12), 0.9)]) for k in range(24)]
    log = K.trace(path + [(24 + k, 2.4 + k / 10, []) for k in range(20)], net)
    states = log.after.tolist()
    assert states[:3] == ["tracking", "tracking", "active"] and "lost" in states and states[-1] == "idle"
    (r,) = K.rallies(log, net).to_dict("records")
    assert r["end_reason"] == "ball absent (timeout)" and r["side_changes"] == r["net_crossings"] == 2 and r["end_time"] == pytest.approx(2.3)
    still = K.trace([(k, k / 10, [(0.5, 0.3 + 0.02 * min(k, 8), 0.9)]) for k in range(60)], net)
    assert K.rallies(still, net).end_reason.tolist() == ["ball stationary"]
    going = K.rallies(K.trace(path[:12], net), net)
    assert going.end_reason.tolist() == ["video ended"] and going.end_frame.tolist() == [11]
    assert K.rallies(K.trace([], net), net).empty


def test_rallies_of_many_videos_together(spark):
    """Rallies counted over many videos at once, in any portions, are those of each video by itself."""
    rnd, rows, nets, want, log = random.Random(8), [], [], [], []
    for k in range(9):
        video, net = f"v{k}", (0.1, 0.4 + 0.01 * k, 0.8, 0.1)
        nets.append((video, *net))
        x, y, own = 0.5, 0.5, []
        for f in range(rnd.choice([3, 150, 400])):
            x, y = min(0.95, max(0.0, x + rnd.uniform(-0.03, 0.03))), min(0.95, max(0.0, y + rnd.uniform(-0.05, 0.05)))
            balls = [] if (f // 40) % 3 == 2 else [(x, y, 0.02, 0.02, 0.6 + 0.3 * rnd.random())] + [(rnd.random(), rnd.random(), 0.02, 0.02, 0.4)] * (f % 5 == 0)
            own += [(video, f, f / 20, d, *b) for d, b in enumerate(balls or [(None,) * 5])]
        rows += own
        frames = [(f, f / 20, [(r[4] + r[6] / 2, r[5] + r[7] / 2, r[8]) for r in own if r[1] == f and r[4] is not None]) for f in sorted({r[1] for r in own})]
        trace = K.trace(frames, net)
        want += [(video, *r) for r in K.rallies(trace, net).itertuples(index=False, name=None)]
        log += [(video, r.frame, r.after) for r in trace.itertuples()]
    table = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double, conf double").repartition(4)
    net_table = spark.createDataFrame(nets, "video_id string, net_x double, net_y double, net_w double, net_h double")
    got = [tuple(r) for r in stateful.court_rallies(table, net_table).collect()]
    assert len(want) > 9 and max(r[1] for r in want) > 1 and sorted(got) == sorted(want)
    assert sorted((r.video_id, r.frame_idx, r.state) for r in stateful.court_rallies(table, net_table, states=True).collect()) == sorted(log)
    of = {n[0]: n[1:] for n in nets}
    plain = [(r[0], r[2], r[1], *[math.nan if v is None else v for v in r[4:]], *of[r[0]]) for r in rows]
    for size in (1, 30, 200):
        parts = pd.concat(K.rallies_of(iter(plain), K.CourtConfig(), size))
        assert sorted(parts.itertuples(index=False, name=None)) == sorted(want)


def test_scoring(spark):
    p = [("a", 0, 0.0, 10.0), ("a", 1, 20.0, 30.0), ("b", 0, 0.0, 4.0), ("c", 0, 0.0, 10.0), ("c", 1, 5.0, 15.0)]
    t = [("a", 0, 0.0, 10.0), ("a", 1, 22.0, 30.0), ("b", 0, 2.0, 6.0), ("c", 0, 4.0, 12.0), ("d", 0, 0.0, 1.0)]
    schema = "video_id string, seg_idx int, start double, end double"
    predicted, truth = spark.createDataFrame(p, schema), spark.createDataFrame(t, schema)
    matches = E.greedy_match(intervals.iou_pairs(predicted, truth))
    assert sorted((r.video_id, r.p_idx, r.t_idx) for r in matches.collect()) == [("a", 0, 0), ("a", 1, 1), ("c", 1, 0)]
    s = E.score(predicted, truth, matches).first()
    assert (s.tp, s.fp, s.fn) == (3, 2, 2) and s.precision == s.recall == pytest.approx(0.6) and s.start_mae == pytest.approx(1.0)
    per = {r.video_id: r for r in E.score(predicted, truth, matches, ("video_id",)).collect()}
    assert per["b"].f1 == 0 and per["d"].recall == 0 and per["a"].f1 == 1
    none = E.score(predicted.limit(0), truth.limit(0), matches.limit(0)).first()
    assert none.f1 == 0 and none.start_mae == 0


def test_iou_at_the_limit_and_ties(spark):
    schema = "video_id string, seg_idx int, start double, end double"
    truth = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 10.0, 20.0)], schema)
    predicted = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 5.0, 10.0), ("a", 2, 10.0, 20.0)], schema)
    got = E.greedy_match(intervals.iou_pairs(predicted, truth)).collect()
    assert sorted((r.p_idx, r.t_idx) for r in got) == [(0, 0), (2, 1)]


def test_sweep_finds_the_parameters_that_fit(spark):
    rows = [("v", k / 10, 5 <= k / 10 < 15, 5 <= k / 10 < 15 and k % 3 == 0, None) for k in range(300)]
    evidence = spark.createDataFrame(rows, "video_id string, t double, has_ball boolean, is_projectile boolean, ball_y double")
    truth = spark.createDataFrame([("v", 0, 5.2, 15.8)], "video_id string, seg_idx int, start double, end double")
    anchor = {k: float(getattr(C, k)) for k in E.BOUNDS}
    top = E.sweep(evidence, truth, anchor, wide=30, local=10)
    assert 1 <= len(top) <= 5 and top[0]["f1"] == 1.0
    assert [x["rank_score"] for x in top] == sorted((x["rank_score"] for x in top), reverse=True)
    base = E.evaluate_parameters(evidence, truth, spark.createDataFrame([(0, *anchor.values())], "param_id long, " + ", ".join(f"{k} double" for k in E.BOUNDS)), anchor).first()
    replayed = E.replay(evidence, C, padded=False)
    one = E.score(replayed, truth, E.greedy_match(intervals.iou_pairs(replayed, truth))).first()
    assert base.drift == 0 and base.f1 == one.f1 and base.objective == pytest.approx(one.objective)


def sums_alone(videos, own):
    """n_pred, tp, start_in, end_in and errors of one parameter row, video by video and frame by frame."""
    out = [0.0] * 6
    for rows, truth in videos:
        active = by_frames(rows, Config(**{k: own[k] for k in E.BOUNDS if k != "grace_frames"}, grace_frames=round(own["grace_frames"]))) if rows else []
        runs = []
        for k, on in enumerate(active):
            if on and not (k and active[k - 1]):
                end = next((rows[j][0] for j in range(k, len(rows)) if not active[j]), rows[-1][0])
                if runs and rows[k][0] - runs[-1][1] <= own["merge_gap"]:
                    runs[-1][1] = end
                else:
                    runs.append([rows[k][0], end])
        found = [r for r in runs if r[1] - r[0] >= own["min_length"]]
        iou = lambda a, b: max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / (a[1] - a[0] + b[1] - b[0] - max(0.0, min(a[1], b[1]) - max(a[0], b[0])) or 1)
        pairs = sorted((-iou(a, b), i, j) for i, a in enumerate(found) for j, b in enumerate(truth) if a[0] < b[1] and a[1] > b[0] and iou(a, b) >= 0.5)
        out[0] += len(found)
        gone_a, gone_b = set(), set()
        for _, i, j in pairs:
            if i not in gone_a and j not in gone_b:
                gone_a.add(i)
                gone_b.add(j)
                errors = [abs(found[i][k] - truth[j][k]) for k in (0, 1)]
                out = [x + y for x, y in zip(out, [0, 1, errors[0] <= 0.5, errors[1] <= 0.5, *errors], strict=True)]
    return out


def test_sweep_equals_each_replay(spark, monkeypatch):
    """All parameters over all videos in step score as each replay by itself, in portions of any size."""
    rnd, videos = random.Random(5), []
    for k in range(10):
        rows, truth, t = random_frames(k, rnd.choice([1, 40, 140])) if k != 4 else [], [], 0.0
        while t < 20 and k != 7:
            t += rnd.random() * 4
            truth.append((t, t + rnd.random() * 6))
            t = truth[-1][0] + 0.5
        videos.append((rows, truth))
    anchor = {k: float(getattr(C, k)) for k in E.BOUNDS}
    params = E.draw_parameters(spark, {**anchor, "min_length": 0.1}, 60, seed=9)
    listed = [r.asDict() for r in params.collect()]
    want = [sums_alone(videos, own) for own in listed]
    assert sum(w[1] for w in want) > 30
    kinds = {"t": pa.float64(), "has_ball": pa.bool_(), "is_projectile": pa.bool_(), "ball_y": pa.float64()}
    batch = pa.record_batch({**{c: pa.array([[r[j] for r in rows] for rows, _ in videos], pa.list_(kind)) for j, (c, kind) in enumerate(kinds.items())}, "seg_idx": pa.array([list(range(len(x))) if x else None for _, x in videos], pa.list_(pa.int32())), **{c: pa.array([[x[j] for x in truth] if truth else None for _, truth in videos], pa.list_(pa.float64())) for j, c in enumerate(("start", "end"))}})
    for size in (1, 100, 10**6):
        monkeypatch.setattr(replays, "FRAMES", size)
        got = replays.replayed(batch, listed, C)
        assert np.allclose(np.array([got[c] for c in replays.SUMS]).T, want, rtol=0, atol=1e-9)
    evidence = spark.createDataFrame([(k, *r) for k, (rows, _) in enumerate(videos) for r in rows], "video_id long, t double, has_ball boolean, is_projectile boolean, ball_y double").repartition(5)
    truth = spark.createDataFrame([(k, j, *x) for k, (_, own) in enumerate(videos) for j, x in enumerate(own)], "video_id long, seg_idx int, start double, end double")
    scored = {r.param_id: r for r in E.evaluate_parameters(evidence, truth, params, anchor).collect()}
    n_true = sum(len(x) for _, x in videos)
    for own, (n_pred, tp, start_in, end_in, *_) in zip(listed, want, strict=True):
        r = scored[own["param_id"]]
        assert r.f1 == pytest.approx(2 * tp / (n_pred + n_true)) and r.objective == pytest.approx(0.75 * r.f1 + (0.25 * (start_in + end_in) / 2 / tp if tp else 0))


def test_segment_score_and_ema(spark):
    rows = [("v", k / 10, True, 0.05 + 0.001 * k, 0.1 + 0.01 * k, 0.5, 0.5) for k in range(60)]
    evidence = spark.createDataFrame(rows, "video_id string, t double, has_ball boolean, size double, sel_x double, sel_y double, track_y double")
    segments = spark.createDataFrame([("v", 0, 0.0, 5.0)], "video_id string, seg_idx int, start double, end double")
    s = M.segment_score(evidence, segments).first()
    size = [r[3] for r in rows[:51]]
    slope = 0.01 / np.mean(size[:21])
    assert s.continuity == 1 and s.travel == 1 and not s.skyball and s.serve == pytest.approx(min(1, slope / 0.5))
    assert s.size_dynamics == pytest.approx(min(1, np.std(size) / np.mean(size) / 0.25))
    assert s.total == pytest.approx(0.4 * s.serve + 0.25 + 0.2 + 0.15 * s.size_dynamics)
    xs = [2.0, 1.0, 4.0]
    want = xs[0]
    for x in xs[1:]:
        want = 0.35 * x + 0.65 * want
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(xs)], "key string, k int, x double")
    assert M.ema(df, "key", "k", "x").first().ema == pytest.approx(want)


def test_config():
    assert Config().problems() == [] and Config(min_r2=1.5, max_positions=0).problems() == ["min_r2", "max_positions"]
    assert Config().scaled(2).end_timeout == pytest.approx(2 * C.end_timeout) and Config().scaled(2).min_r2 == C.min_r2
