"""Queries that write stored forms and read them back, and those of raw tensors and debug tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import detections as D
from ..operators.settled import shared_folder
from ..sources import versioned, writers
from .roles import FRAMES_SQL, frames, query, table


@query(f"""WITH {FRAMES_SQL}, first AS (SELECT video_id, count(*) AS n, max(value) AS top FROM frames GROUP BY video_id),
second AS (SELECT video_id, CAST(count_if(is_active) AS BIGINT) AS n, max(value) AS top FROM frames WHERE video_id % 3 = 0 GROUP BY video_id)
SELECT f.video_id, CASE WHEN s.video_id IS NULL THEN 1 ELSE 2 END AS content_version, coalesce(s.n, f.n) AS n, coalesce(s.top, f.top) AS top FROM first f LEFT JOIN second s ON f.video_id = s.video_id""")
def documents_saved_twice(spark, sf):
    """A document per video, saved, then those of every third video saved again; the last version of each."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    by = frames(spark, sf).groupBy("video_id")
    versioned.save(by.agg(F.count("*").alias("n"), F.max("value").alias("top")), path, "video_id")
    versioned.save(frames(spark, sf).where("video_id % 3 = 0").groupBy("video_id").agg(F.count_if("is_active").alias("n"), F.max("value").alias("top")), path, "video_id")
    found = versioned.read(spark, path, "video_id long, n long, top double")
    return found.select("video_id", F.col("content_version").cast("int").alias("content_version"), "n", "top")


_S = "least(640.0 / 1280.0, 640.0 / 720.0)"


@query(f"""WITH r AS (SELECT event_id, CAST(value AS DOUBLE) AS x1, CAST(value AS DOUBLE) / 2 AS y1, value + event_id % 50 - 5 AS x2, value / 2 + event_id % 40 - 3 AS y2, (event_id % 100) / 100.0 AS conf FROM events),
k AS (SELECT * FROM r WHERE conf >= 0.25 AND x2 > x1 AND y2 > y1),
s AS (SELECT event_id, conf, greatest(x1, y1, x2, y2) <= 1.5 AS share, x1, y1, x2, y2 FROM k),
p AS (SELECT event_id, conf, CASE WHEN share THEN x1 * 640 ELSE x1 END AS x1, CASE WHEN share THEN y1 * 640 ELSE y1 END AS y1, CASE WHEN share THEN x2 * 640 ELSE x2 END AS x2, CASE WHEN share THEN y2 * 640 ELSE y2 END AS y2 FROM s)
SELECT event_id, round((x1 - (640 - 1280 * {_S}) / 2) / (1280 * {_S}), 8) AS x, round(1 - (y2 - (640 - 720 * {_S}) / 2) / (720 * {_S}), 8) AS y, round((x2 - x1) / (1280 * {_S}), 8) AS w, round((y2 - y1) / (720 * {_S}), 8) AS h, conf FROM p""")
def decoded_tensors(spark, sf):
    """Boxes of raw rows, out of a letterboxed input."""
    e = table(spark, sf, "events")
    v, k = F.col("value").cast("double"), F.col("event_id")
    raw = e.select("event_id", F.array(v, v / 2, v + k % 50 - 5, v / 2 + k % 40 - 3, (k % 100) / 100.0, F.lit(0.0)).alias("raw"))
    out = D.decode(raw, (640, 640), (1280, 720), True, 0.25)
    return out.select("event_id", *[F.round(c, 8).alias(c) for c in ("x", "y", "w", "h")], "conf")


_FIRST = "SELECT user_id AS trajectory_id, {} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = '{}') WHERE k = 1"


@query(f"""WITH q AS ({_FIRST.format('value / 500 AS score, value / 1000 AS smoothness', 'purchase')}), m AS ({_FIRST.format("'m' || event_id AS movement_type", 'signup')}), p AS ({_FIRST.format('event_id % 2 = 0 AS is_valid', 'error')})
SELECT e.event_id, e.user_id AS trajectory_id, coalesce(score, 0) AS score, coalesce(smoothness, 0) AS smoothness, coalesce(movement_type, 'unknown') AS movement_type, coalesce(is_valid, FALSE) AS is_valid
FROM events e LEFT JOIN q ON q.trajectory_id = e.user_id LEFT JOIN m ON m.trajectory_id = e.user_id LEFT JOIN p ON p.trajectory_id = e.user_id""")
def debug_rows(spark, sf):
    """Points with the first quality, kind and verdict of their trajectory."""
    return _debug(spark, sf).select("event_id", "trajectory_id", "score", "smoothness", "movement_type", "is_valid")


def _debug(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "trajectory_id")
    of = lambda kind, *columns: e.where(F.col("event_type") == kind).select("trajectory_id", F.col("event_id").alias("seq"), *columns)
    quality = of("purchase", (F.col("value") / 500).alias("score"), (F.col("value") / 1000).alias("smoothness"))
    kinds, physics = of("signup", F.concat(F.lit("m"), "event_id").alias("movement_type")), of("error", (F.col("event_id") % 2 == 0).alias("is_valid"))
    return writers.debug_table(e, quality, kinds, physics)


@query(f"""WITH q AS ({_FIRST.format('value / 500 AS score', 'purchase')}), m AS ({_FIRST.format("'m' || event_id AS movement_type", 'signup')}), p AS ({_FIRST.format('event_id % 2 = 0 AS is_valid', 'error')})
SELECT e.user_id AS trajectory_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(coalesce(max(score), 0), 6) AS score, coalesce(max(movement_type), 'unknown') AS movement_type, CAST(count_if(coalesce(is_valid, FALSE)) AS BIGINT) AS valid
FROM events e LEFT JOIN q ON q.trajectory_id = e.user_id LEFT JOIN m ON m.trajectory_id = e.user_id LEFT JOIN p ON p.trajectory_id = e.user_id GROUP BY e.user_id""")
def debug_csv(spark, sf):
    """The debug table written as CSV with a header, and read back."""
    path = f"{shared_folder(spark)}/debug-{uuid.uuid4().hex}"
    writers.csv(_debug(spark, sf).select("event_id", "trajectory_id", "score", "movement_type", "is_valid"), path)
    found = spark.read.option("header", True).schema("event_id long, trajectory_id long, score double, movement_type string, is_valid boolean").csv(path)
    return found.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.max("score"), 6).alias("score"), F.max("movement_type").alias("movement_type"), F.count_if("is_valid").alias("valid"))
