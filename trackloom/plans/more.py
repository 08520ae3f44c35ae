"""Queries of operators that the other modules do not run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import catalog as C
from ..operators import detections as D
from ..operators import intervals
from ..operators import metrics as M
from ..operators import social as S
from ..sources import writers
from .motion import SEGMENTS_SQL, _rounded, _segments
from .roles import FRAMES_SQL, VIDEOS_SQL, detections, folders, frames, highlights, profiles, query, table, videos


@query("SELECT user_id AS video_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def movement_counts(spark, sf):
    return M.tally(frames(spark, sf).withColumnRenamed("event_type", "kind"), "video_id", "kind")


@query(f"WITH {VIDEOS_SQL} SELECT folder_path, CAST(sum(file_size) AS BIGINT) AS bytes FROM videos GROUP BY folder_path")
def storage_used(spark, sf):
    return videos(spark, sf).groupBy("folder_path").agg(F.sum("file_size").alias("bytes"))


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL} SELECT video_id, round(sum(en - st), 6) AS posted FROM segments GROUP BY video_id")
def posted_duration(spark, sf):
    return _segments(frames(spark, sf)).groupBy("video_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("posted"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'skip' END AS status, count(*) AS n FROM orders GROUP BY 1")
def result_tallies(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("skip")
    return M.tally(table(spark, sf, "orders").select(status.alias("status")), "status")


@query("SELECT p_partkey AS id, p_retailprice AS price FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def products_by_price(spark, sf):
    return S.page(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), "price", "id")


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey = 11")
def single_profile(spark, sf):
    return S.single(profiles(spark, sf).where("id = 11").select("id", "username"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at FROM orders")
def touched_rows(spark, sf):
    rows = highlights(spark, sf).select("id", F.col("created_at").cast("timestamp_ntz").alias("updated_at"))
    changed = highlights(spark, sf).where("author_id % 3 = 0").select("id")
    return S.touch(rows, changed, "id", F.expr("timestamp_ntz'2024-02-01 00:00:00'"))


@query(f"WITH {FRAMES_SQL} SELECT event_id, CASE WHEN event_type = 'view' THEN 'projectile' WHEN is_active THEN 'vetoed' ELSE 'none' END AS colour, round(coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), t) - t, 6) AS width FROM frames")
def evidence_strip(spark, sf):
    rows = frames(spark, sf).select("event_id", "video_id", "t", F.col("is_active").alias("has_ball"), (F.col("event_type") == "view").alias("is_projectile"))
    return M.strip(rows, "video_id").select("event_id", "colour", F.round("width", 6).alias("width"))


@query("SELECT o_orderkey AS frame, l_linenumber AS det_idx FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY sqrt(pow(l_quantity - 25, 2) + pow(l_linenumber - 3, 2)), l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE k = 1")
def nearest_detection(spark, sf):
    boxes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("det_idx"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"))).alias("boxes"))
    return boxes.select("frame", D.nearest(F.col("boxes"), F.lit(25.0), F.lit(3.0))["det_idx"].alias("det_idx"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT event_id AS probe, video_id, t AS seen FROM frames WHERE event_type = 'signup'),
b AS (SELECT probe, p.video_id, seen, coalesce(max(f.t), any_value(seen) - 24) AS since FROM p LEFT JOIN frames f ON f.video_id = p.video_id AND f.t <= seen - 24 GROUP BY probe, p.video_id, seen)
SELECT probe, event_id FROM b JOIN frames f ON f.video_id = b.video_id AND f.t >= b.since AND f.t <= b.seen""")
def overlay_window(spark, sf):
    f = frames(spark, sf)
    probes = f.where("event_type = 'signup'").select("video_id", F.col("event_id").alias("probe"), F.col("t").alias("at"))
    return intervals.window_with_straddling(f.select("video_id", "event_id", "t"), probes, "video_id", "probe", 24.0).select("probe", "event_id")


@query("SELECT user_id AS video_id, round(avg((value / 500 + value / 400) / 2), 6) AS overall_quality, round(avg(value / 497.3), 6) AS average_r2, round(avg(value / 490.02), 6) AS accuracy FROM events GROUP BY user_id")
def quality_rollup(spark, sf):
    v = F.col("value")
    return _rounded(frames(spark, sf).groupBy("video_id").agg(*M.quality_rollup([v / 500, v / 400], v / 497.3, v / 490.02)), "overall_quality", "average_r2", "accuracy")


@query("SELECT event_id, round(CASE WHEN event_id % 4 < 2 THEN 0.3 ELSE greatest(0.1, least(0.95, (least(1.0, value / 37 / 10) + least(1.0, value / 970 * 5)) / 2)) END, 6) AS confidence FROM events")
def track_confidence(spark, sf):
    v = F.col("value")
    return frames(spark, sf).select("event_id", F.round(M.track_confidence(v / 37, v / 970, F.col("event_id") % 4), 6).alias("confidence"))


@query("SELECT user_id AS video_id, count(*) AS n, round(coalesce(sum(CASE WHEN event_type <> 'error' THEN value END), 0) / count(*), 6) AS mean_value FROM events GROUP BY user_id")
def session_summary(spark, sf):
    rows = frames(spark, sf).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return _rounded(M.session_summary(rows, "video_id", ["value"]), "mean_value")


@query("SELECT user_id AS video_id, CAST(count_if(starts_with(event_type, 'p')) AS BIGINT) AS n FROM events GROUP BY user_id")
def prefixed_names(spark, sf):
    return M.prefixed(frames(spark, sf), "video_id", "event_type", "p")


@query(f"WITH {FRAMES_SQL} SELECT round(avg(CASE WHEN is_active THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(value), 6) AS latency FROM frames WHERE t >= 400")
def recent_accuracy(spark, sf):
    rows = frames(spark, sf).select("t", F.col("is_active").alias("hit"), F.col("value").alias("latency"))
    return _rounded(M.recent_accuracy(rows, "t", F.lit(700.0), 300.0), "accuracy", "latency")


@query("WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) SELECT user_id AS video_id, event_id FROM k WHERE abs(place - (user_id % 9 + 1)) <= 2")
def around_current(spark, sf):
    from pyspark.sql import Window

    rows = frames(spark, sf).select("video_id", "event_id", F.row_number().over(Window.partitionBy("video_id").orderBy("event_id")).alias("place"))
    current = rows.select("video_id", (F.col("video_id") % 9 + 1).alias("at")).distinct()
    return M.around(rows, "video_id", "place", current).select("video_id", "event_id")


@query("SELECT event_id, CASE WHEN value / 480 > 1 THEN 'poor' WHEN value / 480 >= 0.9 THEN 'excellent' WHEN value / 480 >= 0.7 THEN 'good' WHEN value / 480 >= 0.5 THEN 'acceptable' ELSE 'poor' END AS quality, CASE WHEN value / 25 > 15 OR event_id % 60 < 15 THEN 'poor' WHEN value / 25 > 8 OR event_id % 60 < 25 THEN 'fair' WHEN value / 25 > 5 OR event_id % 60 < 35 THEN 'good' ELSE 'excellent' END AS performance FROM events")
def quality_levels(spark, sf):
    v = F.col("value")
    return frames(spark, sf).select("event_id", N.quality_level(v / 480).alias("quality"), N.performance_level(v / 25, F.col("event_id") % 60).alias("performance"))


@query("SELECT user_id AS video_id, CAST(ts AS DATE) AS day, round(CASE WHEN count(*) < 2 THEN 0.0 WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 1.0 END, 6) AS open_cv, round(CASE WHEN count_if(value > 0) >= 2 THEN greatest(0.0, least(1.0, 1 - stddev_pop(value) FILTER (value > 0) / avg(value) FILTER (value > 0))) ELSE 0.0 END, 6) AS steadiness, round(CASE WHEN count(*) >= 3 AND avg(value) > 1e-9 THEN least(1.0, stddev_pop(value) / avg(value) / 0.25) ELSE 0.0 END, 6) AS dynamics FROM events GROUP BY ALL")
def value_variation(spark, sf):
    by = table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id"), F.to_date("ts").alias("day"))
    return by.agg(*[F.round(c, 6).alias(name) for name, c in M.variation("value").items()])


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'user_' || substr(CAST(c_custkey AS VARCHAR), 1, 8) FROM customer WHERE c_custkey % 2 = 1")
def profiles_for_accounts(spark, sf):
    known = profiles(spark, sf).where("id % 2 = 0").select("id", "username")
    accounts = profiles(spark, sf).select("id", F.col("username").alias("full_name"))
    return S.new_profiles(known, accounts).select("id", "username")


@query(f"WITH {VIDEOS_SQL} SELECT id FROM videos WHERE NOT (folder_path = 'ECONOMY' OR starts_with(folder_path, 'ECONOMY/'))")
def delete_folder_and_videos(spark, sf):
    return C.delete_folder(folders(spark, sf), videos(spark, sf), "ECONOMY")[1].select("id")


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN folder_path = 'ECONOMY' OR starts_with(folder_path, 'ECONOMY/') THEN 'PROMO/' || folder_path ELSE folder_path END AS folder_path FROM videos")
def move_folder(spark, sf):
    return C.move_folder(folders(spark, sf), videos(spark, sf), "ECONOMY", "PROMO")[1].select("id", "folder_path")


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN '' ELSE folder_path END AS folder_path FROM videos")
def move_videos(spark, sf):
    v = videos(spark, sf)
    moves = v.where("id % 10 < 2").select("id", F.when(F.col("id") % 10 == 0, "").otherwise("no such folder").alias("target"))
    return C.move_videos(v, folders(spark, sf), moves)[0].select("id", "folder_path")


@query("SELECT p_partkey AS id, '' AS copies FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_partkey + 1 AS VARCHAR) END FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, '' FROM part WHERE p_partkey % 3 = 2 AND (p_partkey - 1) % 5 <> 0 AND (p_partkey - 1) % 4 <> 0")
def delete_videos(spark, sf):
    v = videos(spark, sf).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 1, F.array((F.col("id") + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("processed_video_ids"))
    n = F.col("id").cast("long")
    gone = v.where(((n % 3 == 1) & (n % 5 == 0)) | ((n % 3 == 2) & ((n - 1) % 4 == 0))).select("id")
    return C.delete_videos(v, gone).select(F.col("id").cast("long").alias("id"), F.array_join("processed_video_ids", ",").alias("copies"))


@query("SELECT o_orderkey AS id, 2 + CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_orderkey IS NOT NULL THEN 1 END), 0) AS BIGINT) AS likes_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def counters_unclamped(spark, sf):
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta"))
    return S.apply_changes(highlights(spark, sf).select("id", F.lit(2).cast("long").alias("likes_count")), changes, "id", "likes_count", clamp=False)


@query(f"WITH {FRAMES_SQL}, {SEGMENTS_SQL} SELECT a.video_id, a.seg_idx, b.seg_idx AS r_seg_idx FROM segments a JOIN segments b ON a.video_id = b.video_id AND a.st <= b.en AND a.en >= b.st")
def overlapping_closed(spark, sf):
    s = _segments(frames(spark, sf))
    return intervals.overlapping(s, s, "video_id", closed=True).select("video_id", "seg_idx", "r_seg_idx")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value / 500 >= 0.6021")
def confident_detections(spark, sf):
    rows = frames(spark, sf).select("event_id", F.initcap("event_type").alias("label"), (F.col("value") / 500).alias("conf"))
    return D.confident(rows, labels=("view",)).select("event_id")


@query("WITH k AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame_idx FROM events) SELECT video_id, frame_idx, 3 AS n FROM k WHERE frame_idx = 1 OR frame_idx % 5 = 0")
def sampled_frames(spark, sf):
    d = detections(spark, sf)
    return D.sampled(d.select("video_id", "frame_idx").distinct(), d, 5).select("video_id", "frame_idx", F.size("boxes").alias("n"))


@query("SELECT o_orderkey AS item_id, 'pass' AS before, CASE o_orderstatus WHEN 'O' THEN 'fail' ELSE 'skip' END AS after FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F'")
def status_changes(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Passed").when(F.col("o_orderstatus") == "O", "Failed").otherwise("Skipped")
    results = o.select(F.col("o_orderkey").cast("string").alias("name"), status.alias("status"))
    items = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").cast("string").alias("automation_id"), F.lit("pass").alias("status"))
    return writers.status_changes(results, items)[0]


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN folder_path = 'ECONOMY' THEN '' WHEN starts_with(folder_path, 'ECONOMY/') THEN substr(folder_path, 9) END AS relative, CASE WHEN folder_path = '' THEN 'lib' ELSE 'lib/' || folder_path END AS whole FROM videos")
def path_conversions(spark, sf):
    return videos(spark, sf).select("id", C.relative_path(F.col("folder_path"), "ECONOMY").alias("relative"), C.full_path(F.col("folder_path"), "lib").alias("whole"))


_ODD = "CASE p_partkey % 8 WHEN 0 THEN chr(9) || p_name WHEN 1 THEN p_name || chr(10) WHEN 2 THEN p_name || chr(160) WHEN 3 THEN '.' || p_name WHEN 4 THEN 'lpt1' WHEN 5 THEN ' a/b:c ' WHEN 6 THEN repeat(p_name, 20) ELSE '  ' END"


@query(f"WITH n AS (SELECT p_partkey AS id, p_name, {_ODD} AS name FROM part) SELECT id, FALSE AS is_valid, CASE id % 8 WHEN 3 THEN name WHEN 4 THEN name WHEN 5 THEN 'a_b_c' WHEN 6 THEN substr(name, 1, 255) WHEN 7 THEN 'New Folder' ELSE p_name END AS clean FROM n WHERE NOT (id % 8 = 6 AND length(name) <= 255)")
def odd_folder_names(spark, sf):
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    odd = F.when(k == 0, F.concat(F.lit("\t"), name)).when(k == 1, F.concat(name, F.lit("\n"))).when(k == 2, F.concat(name, F.lit(" "))).when(k == 3, F.concat(F.lit("."), name)).when(k == 4, "lpt1").when(k == 5, " a/b:c ").when(k == 6, F.repeat(name, 20)).otherwise("  ")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), odd.alias("name")).where(~((F.col("id") % 8 == 6) & (F.length("name") <= 255)))
    return rows.select("id", T.valid_folder_name(F.col("name")).alias("is_valid"), T.sanitized_folder_name(F.col("name")).alias("clean"))


@query("SELECT p_partkey AS id, round(p_size * abs(cos(radians(p_partkey % 90))) + 3 * abs(sin(radians(p_partkey % 90))), 6) AS w, round(p_size * abs(sin(radians(p_partkey % 90))) + 3 * abs(cos(radians(p_partkey % 90))), 6) AS h FROM part")
def turned_boxes(spark, sf):
    w, h = N.upright_size(F.col("p_size").cast("double"), F.lit(3.0), (F.col("p_partkey") % 90).cast("double"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))
