"""Queries over frames, tracks and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import detections as D
from ..operators import evaluate as E
from ..operators import gate, intervals, stateful
from ..operators import metrics as M
from ..operators.config import Config
from .roles import FRAMES_SQL, detections, frames, query

C = Config()
_W = "(PARTITION BY video_id ORDER BY t)"
#: Runs of active frames, then segments: padded, within 0 and 720, merged, long enough.
ISLANDS_SQL = f"""m AS (SELECT *, lead(t) OVER {_W} AS nx, CASE WHEN is_active AND NOT coalesce(lag(is_active) OVER {_W}, FALSE) THEN 1 ELSE 0 END AS s FROM frames),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM m),
islands AS (SELECT video_id, run, min(t) AS st, coalesce(arg_max(coalesce(nx, 720.0), t), 720.0) AS en FROM r WHERE is_active GROUP BY video_id, run)"""
SEGMENTS_SQL = f"""{ISLANDS_SQL},
padded AS (SELECT video_id, greatest(0.0, st - CASE WHEN en - st < {C.short_sec} THEN {C.short_preroll} ELSE {C.preroll} END) AS st, least(720.0, en + {C.postroll}) AS en FROM islands),
marked AS (SELECT *, CASE WHEN st - max(en) OVER (PARTITION BY video_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {C.merge_gap} THEN 0 ELSE 1 END AS fresh FROM padded WHERE en > st),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY st, en) AS g FROM marked),
merged AS (SELECT video_id, min(st) AS st, max(en) AS en FROM grouped GROUP BY video_id, g),
segments AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY st) - 1 AS INTEGER) AS seg_idx, st, en FROM merged WHERE en - st >= {C.min_length})"""


#: Hours that the events span.
DURATION = 720.0


def _segments(f):
    return intervals.build(f, duration=DURATION)


def _physics(f):
    return f.select("video_id", "t", (F.col("event_type") != "error").alias("is_valid"), (F.col("value") / 497.3).alias("r2"), (F.col("value") / 490.02).alias("confidence"))


def _trajectories(f):
    return f.where("event_type = 'click'").select("video_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"), F.floor("value").cast("double").alias("n_points"))


_METRICS_SQL = """p AS (SELECT s.video_id, s.seg_idx, avg(f.value / 490.02) AS confidence, avg(CASE WHEN event_type <> 'error' AND value / 497.3 > 0 THEN value / 497.3 END) AS quality, count(*) AS detection_count
  FROM segments s JOIN frames f ON f.video_id = s.video_id AND f.t BETWEEN s.st AND s.en GROUP BY ALL),
tr AS (SELECT s.video_id, s.seg_idx, avg(floor(value)) AS mean_trajectory_length FROM segments s JOIN frames f ON f.video_id = s.video_id AND event_type = 'click' AND f.t < s.en AND f.t + value / 100 > s.st GROUP BY ALL)
SELECT s.video_id, s.seg_idx, round(st, 6) AS start, round(en, 6) AS "end", round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(quality, 0), 6) AS quality, coalesce(detection_count, 0) AS detection_count, round(coalesce(mean_trajectory_length, 0), 6) AS mean_trajectory_length
FROM segments s LEFT JOIN p ON p.video_id = s.video_id AND p.seg_idx = s.seg_idx LEFT JOIN tr ON tr.video_id = s.video_id AND tr.seg_idx = s.seg_idx"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL}, {_METRICS_SQL}")
def rally_segments(spark, sf):
    """Runs of activity to segments with their metrics: the pipeline from frames to results."""
    f = frames(spark, sf)
    out = M.segment_metrics(_segments(f), _physics(f), _trajectories(f), limits=False)
    return _rounded(out, "start", "end", "confidence", "quality", "mean_trajectory_length")


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL}, {_METRICS_SQL}")
def range_join_metrics(spark, sf):
    """The same by binned range joins."""
    f = frames(spark, sf)
    out = M.segment_metrics(_segments(f), _physics(f), _trajectories(f), limits=False, bin_width=8.0)
    return _rounded(out, "start", "end", "confidence", "quality", "mean_trajectory_length")


@query(f"WITH {FRAMES_SQL}, {ISLANDS_SQL} SELECT video_id, round(st, 6) AS start, round(en, 6) AS \"end\" FROM islands")
def activity_islands(spark, sf):
    f = frames(spark, sf)
    return _rounded(intervals.islands(f, duration=DURATION), "start", "end")


@query("SELECT user_id AS video_id, CAST(count_if(value / 490.02 >= 0.8) AS BIGINT) AS high, CAST(count_if(value / 490.02 >= 0.5 AND value / 490.02 < 0.8) AS BIGINT) AS medium, CAST(count_if(value / 490.02 < 0.5) AS BIGINT) AS low FROM events GROUP BY user_id")
def confidence_histogram(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(*M.histogram(F.col("value") / 490.02))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT video_id, t - lag(t) OVER {_W} AS dt, abs(value - lag(value) OVER {_W}) AS dv FROM frames), v AS (SELECT video_id, dv / dt AS v FROM l WHERE dt > 0)
SELECT video_id, round(CASE WHEN avg(v) > 0 THEN least(1.0, stddev_pop(v) / avg(v)) ELSE 1.0 END, 6) AS cv FROM v GROUP BY video_id""")
def lag_velocity_cv(spark, sf):
    points = frames(spark, sf).select("video_id", "t", F.lit(0.0).alias("x"), F.col("value").alias("y"))
    return _rounded(M.speed_variation(points), "cv")


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT video_id, (t - min(t) OVER (PARTITION BY video_id)) / 720 AS t, value / 500 AS y FROM frames),
s AS (SELECT video_id, CAST(count(*) AS DOUBLE) AS n, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(y) AS y0, sum(t*y) AS y1, sum(t*t*y) AS y2 FROM x GROUP BY video_id),
d AS (SELECT *, s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM s WHERE n >= 3)
SELECT video_id, round((y2*(s2*n-s1*s1) - s3*(y1*n-s1*y0) + s2*(y1*s1-s2*y0)) / det, 4) AS a, round((s4*(y1*n-y0*s1) - y2*(s3*n-s1*s2) + s2*(s3*y0-y1*s2)) / det, 4) AS b, round((s4*(s2*y0-s1*y1) - s3*(s3*y0-s2*y1) + y2*(s3*s1-s2*s2)) / det, 4) AS c FROM d WHERE abs(det) > 1e-18""")
def quad_fit_per_key(spark, sf):
    """A fit per key from sums alone, so that it combines before the shuffle."""
    f = frames(spark, sf)
    t0 = f.groupBy(F.col("video_id").alias("v")).agg(F.min("t").alias("t0"))
    x = f.join(t0, F.col("video_id") == F.col("v")).select("video_id", ((F.col("t") - F.col("t0")) / 720).alias("t"), (F.col("value") / 500).alias("y"))
    t, y = F.col("t"), F.col("y")
    s = x.groupBy("video_id").agg(F.count("*").cast("double").alias("n"), F.sum(t).alias("s1"), F.sum(t * t).alias("s2"), F.sum(t * t * t).alias("s3"), F.sum(t * t * t * t).alias("s4"), F.sum(y).alias("y0"), F.sum(t * y).alias("y1"), F.sum(t * t * y).alias("y2"))
    a, b, c, det = N.solve_quadratic(F.col("n"), [F.col(k) for k in ("s1", "s2", "s3", "s4")], [F.col(k) for k in ("y0", "y1", "y2")])
    s = s.withColumn("det", det).where("n >= 3 and abs(det) > 1e-18")
    return s.select("video_id", F.round(a / F.col("det"), 4).alias("a"), F.round(b / F.col("det"), 4).alias("b"), F.round(c / F.col("det"), 4).alias("c"))


@query(f"""WITH {FRAMES_SQL}, {SEGMENTS_SQL}, o AS (SELECT s.video_id, s.seg_idx, f.t, f.value, row_number() OVER (PARTITION BY s.video_id, s.seg_idx ORDER BY f.t, f.value) AS k, f.t - min(f.t) OVER (PARTITION BY s.video_id, s.seg_idx) AS dt
  FROM segments s JOIN frames f ON f.video_id = s.video_id AND f.t BETWEEN s.st AND s.en),
q AS (SELECT video_id, seg_idx, CAST(count(*) AS DOUBLE) AS n, sum(dt) AS sx, sum(value) AS sy, sum(dt * value) AS sxy, sum(dt * dt) AS sxx FROM o WHERE k <= 10 GROUP BY ALL)
SELECT video_id, seg_idx, round(CASE WHEN n >= 3 AND abs(n * sxx - sx * sx) > 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END, 4) AS trend FROM q""")
def ols_first_n(spark, sf):
    f = frames(spark, sf)
    return _rounded(M.size_trend(f.select("video_id", "t", F.col("value").alias("area")), _segments(f)), "trend", digits=4)


@query("SELECT user_id AS video_id, round(median(value), 6) AS x, round(median(value * 2), 6) AS y, round(avg(value), 6) AS conf FROM events GROUP BY user_id")
def median_box(spark, sf):
    f = frames(spark, sf).select("video_id", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), F.col("value").alias("conf"))
    return _rounded(D.median_box(f), "x", "y", "conf").select("video_id", "x", "y", "conf")


@query(f"WITH {FRAMES_SQL}, k AS (SELECT *, CAST(round(t * 600) AS BIGINT) AS tick FROM frames) SELECT event_id, round(count_if(is_active) OVER (PARTITION BY video_id ORDER BY tick RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) / 24.0, 6) AS rate FROM k")
def sliding_rate(spark, sf):
    return M.trailing_rate(frames(spark, sf), "video_id", "t", "is_active", 24.0).select("event_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER {_W} THEN 0 ELSE 1 END AS ch FROM frames), r AS (SELECT *, sum(ch) OVER {_W} AS run FROM c)
SELECT video_id, CAST(run AS BIGINT) AS run, event_type AS state, round(min(t), 6) AS first, count(*) AS n FROM r GROUP BY video_id, run, event_type""")
def state_rle(spark, sf):
    out = M.runs(frames(spark, sf), "video_id", "t", "event_type")
    return out.select("video_id", "run", F.col("event_type").alias("state"), F.round("first", 6).alias("first"), "n")


@query(f"WITH {FRAMES_SQL}, c AS (SELECT *, lag(is_active) OVER {_W} AS before FROM frames) SELECT event_id, CASE WHEN is_active THEN 'start' ELSE 'end' END AS change FROM c WHERE is_active <> coalesce(before, FALSE)")
def transitions(spark, sf):
    before = F.coalesce(F.lag("is_active").over(Window.partitionBy("video_id").orderBy("t")), F.lit(False))
    return frames(spark, sf).withColumn("before", before).where("is_active <> before").select("event_id", F.when(F.col("is_active"), "start").otherwise("end").alias("change"))


@query(f"""WITH {FRAMES_SQL} SELECT p.event_id, r.value AS value FROM frames p ASOF LEFT JOIN (SELECT video_id, t, value FROM frames WHERE event_type = 'click') r ON p.video_id = r.video_id AND p.t >= r.t WHERE p.event_type = 'error'""")
def asof_lookup(spark, sf):
    f = frames(spark, sf)
    return intervals.as_of(f.where("event_type = 'error'").select("event_id", "video_id", "t"), f.where("event_type = 'click'"), "video_id", "t", "value").select("event_id", "value")


_NEAR = "SELECT p.event_id, r.event_id AS r_id, p.t AS pt, r.t AS rt, row_number() OVER (PARTITION BY p.event_id ORDER BY {order}) AS k FROM frames p JOIN frames r ON p.video_id = r.video_id AND r.event_type = 'click' AND {test} WHERE p.event_type = 'error'"


@query(f"WITH {FRAMES_SQL}, n AS ({_NEAR.format(order='abs(p.t - r.t), r.event_id', test='abs(p.t - r.t) <= 6')}) SELECT event_id, r_id FROM n WHERE k = 1")
def nearest_within_tol(spark, sf):
    f = frames(spark, sf).select("event_id", "video_id", "t", "event_type")
    rows = f.where("event_type = 'click'").select("video_id", "t", F.col("event_id").alias("id"))
    return intervals.nearest_within(f.where("event_type = 'error'"), rows, "video_id", "t", "id", 6.0, "event_id").select("event_id", "r_id")


@query(f"WITH {FRAMES_SQL}, n AS ({_NEAR.format(order='r.event_id', test='abs(p.t - r.t) < 6')}) SELECT event_id, r_id FROM n WHERE k = 1")
def first_within_tol(spark, sf):
    f = frames(spark, sf).select("event_id", "video_id", "t", "event_type")
    rows = f.where("event_type = 'click'").select("video_id", "t", F.col("event_id").alias("id"))
    return intervals.first_within(f.where("event_type = 'error'"), rows, "video_id", "t", "id", 6.0, "event_id").select("event_id", "r_id")


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL} SELECT DISTINCT event_id FROM frames f JOIN segments s ON f.video_id = s.video_id AND f.t >= s.st - 0.25 AND f.t <= s.en + 0.25 WHERE s.seg_idx = 0")
def scoped_evidence(spark, sf):
    f = frames(spark, sf)
    return intervals.in_range(f, _segments(f).where("seg_idx = 0"), "video_id", margin=0.25, how="left_semi").select("event_id")


#: Labels: the segments, moved and stretched.
_TRUTH = "truth AS (SELECT video_id, seg_idx, st + (seg_idx % 3) * 0.8 AS st, en + (video_id % 4) * 0.9 AS en FROM segments WHERE (video_id + seg_idx) % 5 <> 0)"
_IOU = "(least(p.en, t.en) - greatest(p.st, t.st)) / ((p.en - p.st) + (t.en - t.st) - (least(p.en, t.en) - greatest(p.st, t.st)))"
_PAIRS = f"pairs AS (SELECT p.video_id, p.seg_idx AS p_idx, t.seg_idx AS t_idx, {_IOU} AS iou, p.st AS ps, p.en AS pe, t.st AS ts, t.en AS te FROM segments p JOIN truth t ON p.video_id = t.video_id AND p.st < t.en AND p.en > t.st WHERE {_IOU} >= 0.5)"


def _truth(segments):
    moved = segments.withColumns({"start": F.col("start") + (F.col("seg_idx") % 3) * 0.8, "end": F.col("end") + (F.col("video_id") % 4) * 0.9})
    return moved.where("(video_id + seg_idx) % 5 <> 0")


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL}, {_TRUTH}, {_PAIRS} SELECT video_id, p_idx, t_idx, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, sf):
    s = _segments(frames(spark, sf))
    return intervals.iou_pairs(s, _truth(s)).select("video_id", "p_idx", "t_idx", F.round("iou", 6).alias("iou"))


def _matched(spark, sf):
    s = _segments(frames(spark, sf))
    t = _truth(s)
    return s, t, E.greedy_match(intervals.iou_pairs(s, t))


#: Above one half a predicted and a true segment can have one partner only, so greedy matching keeps all pairs; those at one half exactly do not occur.
@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL}, {_TRUTH}, {_PAIRS} SELECT video_id, p_idx, t_idx, round(iou, 6) AS iou FROM pairs")
def iou_greedy_match(spark, sf):
    return _matched(spark, sf)[2].select("video_id", "p_idx", "t_idx", F.round("iou", 6).alias("iou"))


@query(f"""WITH {FRAMES_SQL}, {SEGMENTS_SQL}, {_TRUTH}, {_PAIRS}, c AS (SELECT (SELECT count(*) FROM segments) AS n_pred, (SELECT count(*) FROM truth) AS n_true, count(*) AS tp, avg(abs(ps - ts)) AS start_mae, avg(abs(pe - te)) AS end_mae FROM pairs)
SELECT tp, n_pred - tp AS fp, n_true - tp AS fn, round(tp / n_pred, 6) AS "precision", round(tp / n_true, 6) AS recall, round(2.0 * tp / (n_pred + n_true), 6) AS f1, round(start_mae, 6) AS start_mae, round(end_mae, 6) AS end_mae FROM c""")
def pooled_f1(spark, sf):
    s, t, m = _matched(spark, sf)
    out = _rounded(E.score(s, t, m), "precision", "recall", "f1", "start_mae", "end_mae")
    return out.select("tp", "fp", "fn", "precision", "recall", "f1", "start_mae", "end_mae")


def _evidence(spark, sf):
    f = frames(spark, sf)
    return f.select("video_id", "t", F.col("is_active").alias("has_ball"), F.col("event_type").isin("view", "purchase").alias("is_projectile"), (F.col("value") / 500).alias("ball_y"))


#: A day stands for a second here: events lie hours apart.
SLOW = Config().scaled(24.0)


@query()
def param_sweep(spark, sf):
    """Scores of a small seeded grid, all parameters, not only the best."""
    anchor = {k: float(getattr(Config(), k)) for k in E.BOUNDS}
    rows = _evidence(spark, sf).withColumn("t", F.col("t") / 24)
    s = _segments(frames(spark, sf))
    truth = _truth(s).withColumns({"start": F.col("start") / 24, "end": F.col("end") / 24})
    out = E.evaluate_parameters(rows, truth, E.draw_parameters(spark, anchor, 40, seed=3), anchor)
    return out.select("param_id", *[F.round(c, 6).alias(c) for c in ("f1", "objective", "drift", "rank_score")])


def _points(spark, sf):
    return stateful.track(D.suppress_static(D.dedupe_by_center(detections(spark, sf))))


@query()
def kalman_track(spark, sf):
    return _points(spark, sf).select("video_id", "frame_idx", "det_idx", "track_id", "age", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def kalman_track_strided(spark, sf):
    """Tracks of the frames that the tracker itself chooses to look at."""
    rows = stateful.track(D.dedupe_by_center(detections(spark, sf)), stride=True)
    return rows.select("video_id", "frame_idx", "det_idx", "track_id", "age", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def physics_gate(spark, sf):
    return stateful.gated(_points(spark, sf)).select("video_id", "frame_idx", "track_id", "is_valid", F.round("r2", 6).alias("r2"), "movement_type", "rejection_reason")


@query()
def tracked_rallies(spark, sf):
    """Detections to segments: clean, track, gate, select, decide, build."""
    points = stateful.gated(_points(spark, sf))
    seen = detections(spark, sf).select("video_id", "t").distinct()
    active = stateful.decide(stateful.select(points, seen))
    return _rounded(intervals.build(active), "start", "end")


@query()
def court_rallies(spark, sf):
    d = detections(spark, sf)
    nets = d.select("video_id").distinct().select("video_id", F.lit(0.1).alias("net_x"), F.lit(0.4).alias("net_y"), F.lit(0.8).alias("net_w"), F.lit(0.2).alias("net_h"))
    return stateful.court_rallies(d, nets)


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY value, event_id) AS place FROM frames WHERE value <= 245) SELECT video_id, event_id AS seg_idx, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def topk_bottom_conf(spark, sf):
    f = frames(spark, sf).select("video_id", F.col("event_id").alias("seg_idx"), F.col("value").alias("confidence"))
    return M.least_confident(f, most=245.0).select("video_id", "seg_idx", "place")


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT video_id, event_id, value / 100 AS x FROM frames), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM s)
SELECT video_id, round(sum(x * CASE WHEN k = 1 THEN 1.0 ELSE 0.35 END * pow(0.65, n - k)), 6) AS ema FROM n GROUP BY video_id""")
def ema_ratio(spark, sf):
    rows = frames(spark, sf).select("video_id", "event_id", (F.col("value") / 100).alias("x"))
    return _rounded(M.ema(rows, "video_id", "event_id", "x"), "ema")


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL} SELECT video_id, seg_idx, round(coalesce(sum(en - st) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS \"offset\" FROM segments")
def edit_list(spark, sf):
    return M.append_offsets(_segments(frames(spark, sf)), "video_id", "seg_idx").select("video_id", "seg_idx", F.round("offset", 6).alias("offset"))


@query(f"""WITH {FRAMES_SQL} SELECT video_id, count(*) AS total_frames, CAST(count_if(event_type <> 'signup') AS BIGINT) AS processed_frames, CAST(count_if(value > 100) AS BIGINT) AS detection_frames, CAST(count_if(is_active) AS BIGINT) AS rally_frames,
round(count_if(event_type <> 'signup') / count(*), 6) AS completeness, round(CASE WHEN count_if(event_type <> 'signup') > 0 THEN count_if(value > 100) / count_if(event_type <> 'signup') ELSE 0 END, 6) AS detection_rate FROM frames GROUP BY video_id""")
def frame_stats(spark, sf):
    f = frames(spark, sf).select("video_id", (F.col("event_type") != "signup").alias("processed"), (F.col("value") > 100).cast("int").alias("n_detections"), F.lit(1).alias("n_tracks"), "is_active", F.col("is_active").alias("is_valid"), F.col("value").alias("confidence"))
    return _rounded(M.frame_stats(f), "completeness", "detection_rate").select("video_id", "total_frames", "processed_frames", "detection_frames", "rally_frames", "completeness", "detection_rate")


@query(f"WITH {FRAMES_SQL} SELECT video_id, round(CASE WHEN stddev_pop(t) > 0 AND stddev_pop(value) > 0 THEN pow(corr(t, value), 2) ELSE 0 END, 6) AS r2 FROM frames GROUP BY video_id")
def squared_correlation(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(F.round(M.squared_correlation("t", "value"), 6).alias("r2"))


@query(f"WITH {FRAMES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t DESC) AS place FROM frames) SELECT event_id FROM k WHERE place <= 30")
def trail_points(spark, sf):
    return M.last_rows(frames(spark, sf), "video_id", "t", 30).select("event_id")


@query()
def movement_types(spark, sf):
    point = F.struct((F.col("t") / 720).alias("t"), (F.col("event_id") % 7 / 7.0).alias("x"), (F.col("value") / 500).alias("y"))
    tracks = frames(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    out = gate.classify(tracks)
    return out.select("video_id", "movement_type", *[F.round(c, 6).alias(c) for c in ("inconsistency", "acceleration", "smoothness", "vertical", "type_confidence")])


@query()
def segment_scores(spark, sf):
    f = frames(spark, sf)
    evidence = f.select("video_id", "t", F.col("is_active").alias("has_ball"), (F.col("value") / 5000).alias("size"), F.when(F.col("event_type") != "error", F.col("value") / 500).alias("sel_x"), F.when(F.col("event_type") != "error", F.col("event_id") % 10 / 10.0).alias("sel_y"), (F.col("value") / 500).alias("track_y"))
    return M.segment_score(evidence, _segments(f), window=24.0).select("video_id", "seg_idx", "skyball", *[F.round(c, 6).alias(c) for c in ("serve", "travel", "continuity", "size_dynamics", "total")])


@query(f"WITH {FRAMES_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t DESC) AS k FROM frames), s AS (SELECT video_id, abs(value - lag(value) OVER {_W}) / (t - lag(t) OVER {_W}) AS v FROM l WHERE k <= 3) SELECT video_id, round(coalesce(sum(v), 0) / greatest(count(*) - 1, 1), 6) AS velocity FROM s GROUP BY video_id")
def recent_velocity(spark, sf):
    points = frames(spark, sf).select("video_id", "t", F.lit(0.0).alias("x"), F.col("value").alias("y"))
    return _rounded(M.recent_velocity(points, "video_id"), "velocity")


@query(f"WITH {FRAMES_SQL} SELECT event_id, round(avg(value / 7.0) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 5) AS mean_area FROM frames")
def recent_area(spark, sf):
    points = frames(spark, sf).withColumns({"w": F.col("value"), "h": F.lit(1 / 7)})
    return _rounded(M.recent_area(points, "video_id"), "mean_area", digits=5).select("event_id", "mean_area")


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t DESC) AS k FROM frames)
SELECT video_id, count(DISTINCT event_type) AS items, round(avg(CASE WHEN k <= 10 AND event_type <> 'error' THEN value END), 5) AS mean_last, arg_max(value, t) FILTER (WHERE event_type <> 'error') AS last_value FROM l WHERE k <= 100 GROUP BY video_id""")
def realtime_snapshot(spark, sf):
    f = frames(spark, sf).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return _rounded(M.snapshot(f, "video_id", "t", "event_type", "value"), "mean_last", digits=5)


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT p.event_id AS probe, f.event_id, f.event_type, row_number() OVER (PARTITION BY p.event_id, f.event_type ORDER BY f.t DESC) AS k
FROM frames f JOIN frames p ON p.video_id = f.video_id AND p.event_type = 'signup' AND f.t >= p.t - 48 AND f.t <= p.t + 0.1) SELECT probe, event_id FROM p WHERE k <= 3""")
def overlay_trail(spark, sf):
    f = frames(spark, sf)
    probes = f.where("event_type = 'signup'").select("video_id", F.col("event_id").alias("probe"), F.col("t").alias("at"))
    points = f.select("video_id", "event_id", "t", F.col("event_type").alias("track_id"))
    return intervals.trail(points, probes, "video_id", "probe", history=48.0, n=3).select("probe", "event_id")


def _staged(f):
    """The first 20 videos by id, as text, before '2'."""
    return f.where("video_id < '2'").select(F.col("video_id").alias("local_video_id")).distinct().orderBy("local_video_id").limit(20)


@query(f"""WITH {FRAMES_SQL}, m AS (SELECT *, lead(t) OVER {_W} AS nx, CASE WHEN is_active AND NOT coalesce(lag(is_active) OVER {_W}, FALSE) THEN 1 ELSE 0 END AS s FROM frames),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM m),
islands AS (SELECT video_id, run, min(t) AS st, arg_max(coalesce(nx, t), t) AS en FROM r WHERE is_active GROUP BY video_id, run),
padded AS (SELECT video_id, greatest(0.0, st - CASE WHEN en - st < {C.short_sec} THEN {C.short_preroll} ELSE {C.preroll} END) AS st, en + {C.postroll} AS en FROM islands),
marked AS (SELECT *, CASE WHEN st - max(en) OVER (PARTITION BY video_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {C.merge_gap} THEN 0 ELSE 1 END AS fresh FROM padded),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY st, en) AS g FROM marked),
merged AS (SELECT video_id, min(st) AS st, max(en) AS en FROM grouped GROUP BY video_id, g),
segments AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY st) - 1 AS seg_idx, st, en FROM merged WHERE en - st >= {C.min_length}),
sure AS (SELECT CAST(s.video_id AS VARCHAR) AS video_id, s.seg_idx, coalesce(avg(f.value / 490.02), 0) AS confidence FROM segments s LEFT JOIN frames f ON f.video_id = s.video_id AND f.t BETWEEN s.st AND s.en GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence, seg_idx) AS place FROM sure WHERE confidence <= 0.5),
staged AS (SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id FROM frames WHERE CAST(video_id AS VARCHAR) < '2' ORDER BY 1 LIMIT 20),
added AS (SELECT DISTINCT video_id FROM chosen WHERE place <= 2 AND video_id NOT IN (SELECT video_id FROM staged) ORDER BY 1 LIMIT (SELECT greatest(0, 50 - count(*)) FROM staged))
SELECT video_id AS local_video_id, place AS seq, 'low_score' AS reason FROM chosen WHERE place <= 2 AND video_id IN (SELECT video_id FROM staged UNION ALL SELECT video_id FROM added)""")
def passive_capture(spark, sf):
    from ..operators.capture import capture

    f = frames(spark, sf).withColumn("video_id", F.col("video_id").cast("string"))
    segments = M.segment_metrics(intervals.build(f), _physics(f), _trajectories(f), limits=False)
    return capture(segments, f, _staged(f), "me")[0].select("local_video_id", "seq", "reason")
