"""Queries of the operators that step from row to row, with recursive SQL that steps through the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as D
from ..operators import evaluate as E
from ..operators import intervals, stateful
from ..operators.config import Config
from .motion import _IOU, SEGMENTS_SQL, SLOW, _evidence, _rounded, _segments
from .roles import FRAMES_SQL, detections, frames, query

C = Config()
_OVER = "(PARTITION BY video_id ORDER BY t)"


def decider_sql(c: Config) -> str:
    """`active`: whether play is on after each frame of `frames`, by columns for the conditions and recursion for the switch."""
    return f"""evidence AS (SELECT video_id, t, is_active AS ball, event_type IN ('view', 'purchase') AS flight, value / 500 AS y, row_number() OVER {_OVER} AS k FROM frames),
marked AS (SELECT *, max(CASE WHEN flight THEN k END) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flight_before FROM evidence),
past AS (SELECT *, t - max(CASE WHEN ball THEN t END) OVER w AS since_ball, t - max(CASE WHEN flight THEN t END) OVER w AS since_flight, coalesce(last_value(CASE WHEN ball THEN y END IGNORE NULLS) OVER w, 0) AS height,
  k - max(CASE WHEN flight THEN k END) OVER w AS missed, t - max(CASE WHEN flight AND (flight_before IS NULL OR k - flight_before - 1 > {c.grace_frames}) THEN t END) OVER w AS run_for,
  count(CASE WHEN ball THEN 1 END) OVER (PARTITION BY video_id ORDER BY t RANGE BETWEEN {c.evidence_sec} PRECEDING AND CURRENT ROW) AS balls
  FROM marked WINDOW w AS (PARTITION BY video_id ORDER BY k)),
may AS (SELECT video_id, k, t, coalesce(missed <= {c.grace_frames} AND run_for >= {c.start_buffer}, FALSE) AS may_start,
  coalesce(since_flight, 1e9) > {c.recent_sec} AND CASE WHEN height >= {c.sky_y} THEN coalesce(since_ball, 1e9) >= {c.sky_timeout}
  ELSE coalesce(since_ball, 1e9) >= {min(0.8, c.end_timeout)} OR (coalesce(since_flight, 1e9) > 1.5 AND balls / {c.evidence_sec} < 0.5) END AS may_end FROM past),
switch AS (SELECT video_id, k, CASE WHEN may_start THEN t END AS since FROM may WHERE k = 1
  UNION ALL SELECT m.video_id, m.k, CASE WHEN s.since IS NULL THEN CASE WHEN m.may_start THEN m.t END WHEN m.t - s.since >= {c.min_active_sec} AND m.may_end THEN NULL ELSE s.since END
  FROM switch s JOIN may m ON s.video_id = m.video_id AND m.k = s.k + 1),
active AS (SELECT m.video_id, m.t, s.since IS NOT NULL AS is_active FROM may m JOIN switch s ON m.video_id = s.video_id AND m.k = s.k)"""


_DECIDED = f"WITH RECURSIVE {FRAMES_SQL}, {decider_sql(SLOW)}"


@query(f"{_DECIDED} SELECT video_id, round(t, 6) AS t, is_active FROM active")
def rally_decider(spark, sf):
    return _rounded(stateful.decide(_evidence(spark, sf), SLOW), "t")


@query(f"{_DECIDED} SELECT video_id, count(*) AS n, CAST(count_if(is_active) AS BIGINT) AS n_active FROM active GROUP BY video_id")
def decider_pieces(spark, sf):
    """The same videos in pieces of a day and a half, put together."""
    return stateful.decide(_evidence(spark, sf), SLOW, cut=36.0).groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("n_active"))


@query(f"""{_DECIDED}, m AS (SELECT *, lead(t) OVER {_OVER} AS nx, CASE WHEN is_active AND NOT coalesce(lag(is_active) OVER {_OVER}, FALSE) THEN 1 ELSE 0 END AS s FROM active),
r AS (SELECT *, sum(s) OVER {_OVER} AS run FROM m),
islands AS (SELECT video_id, run, min(t) AS st, arg_max(coalesce(nx, t), t) AS en FROM r WHERE is_active GROUP BY video_id, run),
g AS (SELECT *, CASE WHEN st - max(en) OVER (PARTITION BY video_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {SLOW.merge_gap} THEN 0 ELSE 1 END AS fresh FROM islands),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY st, en) AS g FROM g), merged AS (SELECT video_id, min(st) AS st, max(en) AS en FROM h GROUP BY video_id, g)
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY st) - 1 AS INTEGER) AS seg_idx, round(st, 6) AS start, round(en, 6) AS "end" FROM merged WHERE en - st >= {SLOW.min_length}""")
def evidence_replay(spark, sf):
    return _rounded(E.replay(_evidence(spark, sf), SLOW, padded=False), "start", "end")


#: Each segment labelled twice, by two spans that both overlap it and its neighbours.
_DOUBLE_TRUTH = "truth AS (SELECT video_id, 2 * seg_idx + k AS seg_idx, st - CASE WHEN k = 0 THEN 14.0 ELSE -1.5 END AS st, en + CASE WHEN k = 0 THEN 0.5 ELSE 9.0 END AS en FROM segments, (VALUES (0), (1)) AS x(k))"
LEAST_IOU = 0.02
_COMPETING = f"pairs AS (SELECT p.video_id, p.seg_idx AS p_idx, t.seg_idx AS t_idx, {_IOU} AS iou FROM segments p JOIN truth t ON p.video_id = t.video_id AND p.st < t.en AND p.en > t.st WHERE {_IOU} >= {LEAST_IOU})"


@query(f"""WITH RECURSIVE {FRAMES_SQL}, {SEGMENTS_SQL}, {_DOUBLE_TRUTH}, {_COMPETING},
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY iou DESC, p_idx, t_idx) AS k FROM pairs),
greedy AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ts, FALSE AS kept FROM (SELECT DISTINCT video_id FROM pairs)
  UNION ALL SELECT g.video_id, r.k, CASE WHEN list_contains(g.ps, r.p_idx) OR list_contains(g.ts, r.t_idx) THEN g.ps ELSE list_append(g.ps, r.p_idx) END,
  CASE WHEN list_contains(g.ps, r.p_idx) OR list_contains(g.ts, r.t_idx) THEN g.ts ELSE list_append(g.ts, r.t_idx) END, NOT (list_contains(g.ps, r.p_idx) OR list_contains(g.ts, r.t_idx))
  FROM greedy g JOIN ranked r ON g.video_id = r.video_id AND r.k = g.k + 1)
SELECT r.video_id, r.p_idx, CAST(r.t_idx AS INTEGER) AS t_idx, round(r.iou, 6) AS iou FROM ranked r JOIN greedy g ON r.video_id = g.video_id AND r.k = g.k WHERE g.kept""")
def iou_greedy_competing(spark, sf):
    """Greedy matches where nearly every pair competes with others."""
    s = _segments(frames(spark, sf))
    twice = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    start, end = F.when(F.col("k") == 0, 14.0).otherwise(-1.5), F.when(F.col("k") == 0, 0.5).otherwise(9.0)
    truth = twice.select("video_id", (2 * F.col("seg_idx") + F.col("k")).cast("int").alias("seg_idx"), (F.col("start") - start).alias("start"), (F.col("end") + end).alias("end"))
    return E.greedy_match(intervals.iou_pairs(s, truth, least=LEAST_IOU)).select("video_id", "p_idx", "t_idx", F.round("iou", 6).alias("iou"))


_T = "CAST(n AS DOUBLE) / 30"
DETECTIONS_SQL = f"""numbered AS (SELECT user_id AS video_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
detections AS (SELECT video_id, n AS frame_idx, {_T} AS t, k AS det_idx, CASE k WHEN 0 THEN 0.1 + 0.35 * s WHEN 1 THEN 0.7 ELSE (value % 97) / 97 END AS x, CASE k WHEN 0 THEN 0.3 + 0.9 * s - 0.45 * s * s WHEN 1 THEN 0.2 ELSE (value % 89) / 89 END AS y, 0.95 - 0.1 * k AS conf
  FROM (SELECT *, {_T} % 2.0 AS s FROM numbered), (VALUES (0), (1), (2)) AS x(k))"""


def greedy_sql(clash: str) -> str:
    """`kept`: by falling confidence, the boxes of each frame that do not clash (a earlier, b new) with one kept before."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, det_idx) AS k FROM detections),
fold AS (SELECT video_id, frame_idx, k, [{{'det_idx': det_idx, 'x': x, 'y': y}}] AS acc FROM ordered WHERE k = 1
  UNION ALL SELECT f.video_id, f.frame_idx, b.k, CASE WHEN len(list_filter(f.acc, lambda a: {clash})) > 0 THEN f.acc ELSE list_append(f.acc, {{'det_idx': b.det_idx, 'x': b.x, 'y': b.y}}) END
  FROM fold f JOIN ordered b ON f.video_id = b.video_id AND f.frame_idx = b.frame_idx AND b.k = f.k + 1),
whole AS (SELECT video_id, frame_idx, arg_max(acc, k) AS acc FROM fold GROUP BY video_id, frame_idx),
kept AS (SELECT video_id, frame_idx, CAST(unnest(range(0, len(acc))) AS INTEGER) AS kept_idx, unnest(acc) AS box FROM whole)"""


_NEAR = f"sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {C.dedupe_radius}"
_SHARED = "greatest(0.0, least(a.x, b.x) + 0.3 - greatest(a.x, b.x)) * greatest(0.0, least(a.y, b.y) + 0.3 - greatest(a.y, b.y))"


@query(f"WITH RECURSIVE {DETECTIONS_SQL}, {greedy_sql(_NEAR)} SELECT video_id, frame_idx, kept_idx, box.det_idx AS det_idx FROM kept")
def dedupe_greedy(spark, sf):
    return D.dedupe_by_center(detections(spark, sf)).select("video_id", "frame_idx", "kept_idx", "det_idx")


@query(f"WITH RECURSIVE {DETECTIONS_SQL}, {greedy_sql(f'{_SHARED} / (0.18 - {_SHARED}) >= 0.45')} SELECT video_id, frame_idx, kept_idx, box.det_idx AS det_idx FROM kept")
def overlap_suppressed(spark, sf):
    return D.suppress_overlaps(detections(spark, sf).withColumns({"w": F.lit(0.3), "h": F.lit(0.3)})).select("video_id", "frame_idx", "kept_idx", "det_idx")


_GRID = C.static_grid
_CELL = f"greatest(0, least({_GRID - 1}, floor({{}} * {_GRID})))"
STATIC_SQL = f"""hits AS (SELECT k.video_id, k.frame_idx, d.det_idx, k.kept_idx, d.t, d.x + 0.03 / 2 AS cx, d.y + 0.03 / 2 AS cy FROM kept k JOIN detections d ON k.video_id = d.video_id AND k.frame_idx = d.frame_idx AND k.box.det_idx = d.det_idx),
celled AS (SELECT *, {_CELL.format('cy')} * {_GRID} + {_CELL.format('cx')} AS cell FROM hits),
stepped AS (SELECT *, row_number() OVER (PARTITION BY video_id, cell ORDER BY t, kept_idx) AS k FROM celled),
cells AS (SELECT video_id, cell, k, cx, cy, t, 1 AS streak, CAST(0.0 AS DOUBLE) AS muted, TRUE AS stays FROM stepped WHERE k = 1
  UNION ALL SELECT video_id, cell, k, cx, cy, t, CASE WHEN held THEN streak WHEN still THEN streak + 1 ELSE 0 END, CASE WHEN NOT held AND still AND streak + 1 >= {C.static_streak} THEN t + {C.static_mute_sec} ELSE muted END,
  NOT held AND NOT (still AND streak + 1 >= {C.static_streak})
  FROM (SELECT s.video_id, s.cell, s.k, s.cx, s.cy, s.t, c.streak, c.muted, s.t < c.muted AS held,
        sqrt(pow(s.cx - c.cx, 2) + pow(s.cy - c.cy, 2)) < {C.static_distance} AND CASE WHEN s.t > c.t THEN sqrt(pow(s.cx - c.cx, 2) + pow(s.cy - c.cy, 2)) / (s.t - c.t) ELSE 0 END < {C.static_speed} AS still
        FROM cells c JOIN stepped s ON c.video_id = s.video_id AND c.cell = s.cell AND s.k = c.k + 1)),
moving AS (SELECT s.* FROM stepped s JOIN cells c ON s.video_id = c.video_id AND s.cell = c.cell AND s.k = c.k WHERE c.stays)"""


@query(f"WITH RECURSIVE {DETECTIONS_SQL}, {greedy_sql(_NEAR)}, {STATIC_SQL} SELECT video_id, frame_idx, det_idx FROM moving")
def static_suppress(spark, sf):
    return D.suppress_static(D.dedupe_by_center(detections(spark, sf))).select("video_id", "frame_idx", "det_idx")
