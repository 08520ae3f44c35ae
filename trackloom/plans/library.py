"""Library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import metrics as M
from .roles import FOLDERS_SQL, VIDEOS_SQL, folders, query, table, videos

_DEPTH = "CASE WHEN folder_path = '' THEN 0 ELSE len(string_split(folder_path, '/')) END"


@query(f"""WITH {VIDEOS_SQL}, {FOLDERS_SQL},
fc AS (SELECT f.*, (SELECT count(*) FROM videos v WHERE v.folder_path = f.path) AS video_count, (SELECT count(*) FROM folders s WHERE s.parent_path = f.path) AS subfolder_count FROM folders f),
v AS (SELECT 'video' AS kind, CAST(id AS VARCHAR) AS id, custom_name AS name, greatest(0, CASE WHEN lower(custom_name) = 'small' THEN 100.0 WHEN starts_with(lower(custom_name), 'small') THEN 50.0 WHEN contains(lower(custom_name), 'small') THEN 25.0 ELSE 0.0 END
  + CASE WHEN starts_with(file_name, 'small') THEN 30.0 WHEN contains(file_name, 'small') THEN 15.0 ELSE 0.0 END - 2 * len(string_split(folder_path, '/'))) AS score FROM videos WHERE contains(lower(custom_name), 'small') OR contains(file_name, 'small')),
f AS (SELECT 'folder', path, name, CASE WHEN lower(name) = 'small' THEN 100.0 WHEN starts_with(lower(name), 'small') THEN 50.0 ELSE 25.0 END + 0.5 * video_count + 0.3 * subfolder_count FROM fc WHERE contains(lower(name), 'small'))
SELECT kind, id, name, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM f)""")
def relevance_ranked_search(spark, sf):
    v = videos(spark, sf)
    found = C.ranked(v.withColumn("id", F.col("id").cast("string")), C.with_counts(folders(spark, sf), v).withColumns({"created_date": F.lit(None).cast("timestamp_ntz"), "modified_date": F.lit(None).cast("timestamp_ntz")}), "Small")
    return found.select("kind", "id", "name", F.round("score", 6).alias("score"))


@query(f"WITH {VIDEOS_SQL} SELECT id, file_name FROM videos WHERE file_name LIKE '%.mov' AND file_size >= 104857600 AND file_size < 1073741824 AND {_DEPTH} BETWEEN 1 AND 2 AND date_trunc('month', created_date) = TIMESTAMP '2023-09-01'")
def facet_filter(spark, sf):
    now = F.expr("timestamp_ntz'2023-09-20 12:00:00'")
    return C.facets(videos(spark, sf), now, "mov", "month", "medium", (1, 2)).select("id", "file_name")


@query(f"WITH {VIDEOS_SQL} SELECT id FROM videos WHERE (contains(file_name, 'brand#1') OR contains(lower(custom_name), 'brand#1')) AND file_name LIKE '%.mp4' AND file_size BETWEEN 200000000 AND 1500000000 AND created_date BETWEEN TIMESTAMP '2023-07-01' AND TIMESTAMP '2023-12-31' AND (folder_path = 'ECONOMY' OR starts_with(folder_path, 'ECONOMY/'))")
def advanced_search(spark, sf):
    since, until = F.expr("timestamp_ntz'2023-07-01'"), F.expr("timestamp_ntz'2023-12-31'")
    return C.search(videos(spark, sf), "Brand#1", "mp4", 200_000_000, 1_500_000_000, since, until, "ECONOMY").select("id")


@query(f"WITH {VIDEOS_SQL}, {FOLDERS_SQL} SELECT path, (SELECT count(*) FROM videos v WHERE v.folder_path = f.path) AS video_count, (SELECT count(*) FROM folders s WHERE s.parent_path = f.path) AS subfolder_count FROM folders f")
def subtree_counts(spark, sf):
    return C.with_counts(folders(spark, sf), videos(spark, sf)).select("path", "video_count", "subfolder_count")


@query(f"WITH {VIDEOS_SQL} SELECT 'video' AS kind, custom_name AS name FROM videos WHERE contains(lower(custom_name), 'blue') UNION ALL SELECT 'folder', p_type FROM (SELECT DISTINCT p_type FROM part)")
def union_results(spark, sf):
    v = C.search(videos(spark, sf).withColumn("file_name", F.lit("")), "blue").select(F.lit("video").alias("kind"), F.col("custom_name").alias("name"))
    return v.unionByName(folders(spark, sf).where("parent_path is null").select(F.lit("folder").alias("kind"), "name"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark, sf):
    return C.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query(f"WITH {VIDEOS_SQL} SELECT id, folder_path FROM videos WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = id AND l_quantity > 45)")
def stale_entries(spark, sf):
    present = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return C.missing(videos(spark, sf), present, "id").select("id", "folder_path")


@query(f"WITH {VIDEOS_SQL} SELECT id FROM videos WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = id AND l_quantity > 45)")
def existing_entries(spark, sf):
    present = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return C.existing(videos(spark, sf), present, "id").select("id")


@query(f"WITH {VIDEOS_SQL} SELECT id FROM videos WHERE NOT is_processed AND id NOT IN (SELECT original_video_id FROM videos WHERE original_video_id IS NOT NULL)")
def unprocessed(spark, sf):
    return C.unprocessed(videos(spark, sf)).select("id")


@query(f"WITH {VIDEOS_SQL}, {FOLDERS_SQL} SELECT path FROM folders WHERE path IN (SELECT folder_path FROM videos WHERE is_processed)")
def processed_folders(spark, sf):
    return C.folders_with(folders(spark, sf), videos(spark, sf), True).select("path")


@query(f"WITH {VIDEOS_SQL} SELECT id, file_size FROM videos WHERE folder_path = 'ECONOMY' ORDER BY file_size DESC, id LIMIT 15 OFFSET 5")
def browse_by_size(spark, sf):
    return C.browse(videos(spark, sf), "ECONOMY", "size", offset=5, limit=15).select("id", "file_size")


@query(f"WITH {VIDEOS_SQL} SELECT id - 1 AS original_id, id AS copy_id FROM videos WHERE id % 3 = 2")
def copy_links(spark, sf):
    v = videos(spark, sf).withColumn("processed_video_ids", F.when(F.col("id") % 3 == 1, F.array(F.col("id") + 1)).otherwise(F.array().cast("array<bigint>")))
    return C.copies(v)


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN folder_path = 'ECONOMY' THEN 'Thrift/New' WHEN starts_with(folder_path, 'ECONOMY/') THEN 'Thrift/New' || substr(folder_path, 8) ELSE folder_path END AS folder_path FROM videos")
def rename_subtree(spark, sf):
    return C.rename_folder(folders(spark, sf), videos(spark, sf), "ECONOMY", "Thrift/New")[1].select("id", "folder_path")


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN folder_path = 'ECONOMY' OR starts_with(folder_path, 'ECONOMY/') THEN '' ELSE folder_path END AS folder_path FROM videos")
def delete_folder_keep_videos(spark, sf):
    return C.delete_folder(folders(spark, sf), videos(spark, sf), "ECONOMY", keep_videos=True)[1].select("id", "folder_path")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'CON' WHEN p_partkey % 4 = 1 THEN p_type || '/' || p_name WHEN p_partkey % 4 = 2 THEN p_name || '.' ELSE p_name END AS name, p_partkey % 4 = 3 AS is_valid FROM part")
def folder_names(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "CON").when(k == 1, F.concat("p_type", F.lit("/"), "p_name")).when(k == 2, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("is_valid", T.valid_folder_name(F.col("name")))


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN file_size >= 1000000000 THEN 'GB' WHEN file_size >= 1000000 THEN 'MB' ELSE 'KB' END AS unit FROM videos")
def human_sizes(spark, sf):
    return videos(spark, sf).select("id", F.substring(T.human_bytes(F.col("file_size")), -2, 2).alias("unit"))


@query("WITH d AS (SELECT user_id, lower(event_type) AS term, max(ts) AS ts FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, term) AS place FROM d) SELECT user_id, term, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def recent_terms(spark, sf):
    return C.recents(table(spark, sf, "events"), "user_id", "event_type", "ts", 3, any_case=True).select("user_id", F.col("event_type").alias("term"), "place")


@query("SELECT p_brand AS brand, CAST(coalesce(max(CAST(regexp_extract(p_brand || p_size, '^Brand#([0-9]+)', 1) AS BIGINT)), 0) + 1 AS BIGINT) AS next FROM part GROUP BY p_brand")
def next_numbers(spark, sf):
    named = table(spark, sf, "part").withColumn("name", F.concat("p_brand", F.col("p_size").cast("string")))
    return named.groupBy(F.col("p_brand").alias("brand")).agg(T.next_number(F.col("name"), "Brand#").alias("next"))


@query("""WITH f AS (SELECT o_custkey AS user_id, l_partkey AS item, arg_min(l_extendedprice - 20000, o_orderkey * 10 + l_linenumber + l_extendedprice / 1000000) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT user_id, count(*) AS items, round(sum(greatest(0, v)), 2) AS total FROM f GROUP BY user_id""")
def lifetime_dedupe_sum(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item"), (F.col("o_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1000000).alias("seq"), (F.col("l_extendedprice") - 20000).alias("v"))
    return M.lifetime(rows, "user_id", "item", "seq", "v").withColumn("total", F.round("total", 2))


@query("SELECT user_id, round(sum(value) / 60, 6) AS minutes FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-19 12:00:00' GROUP BY user_id")
def weekly_quota(spark, sf):
    now = F.expr("timestamp_ntz'2024-01-19 12:00:00'")
    return M.week_usage(table(spark, sf, "events"), "user_id", "ts", "value", now).withColumn("minutes", F.round("minutes", 6))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'P' THEN 0.25 ELSE 0.0 END), 6) AS progress FROM orders GROUP BY 1")
def upload_summary(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "uploading").otherwise("failed")
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"), status.alias("status"), F.lit(0.25).alias("progress"))
    return M.upload_progress(rows, "done").withColumn("progress", F.round("progress", 6))


_ACTIONS = "CASE event_type WHEN 'view' THEN 'save' WHEN 'click' THEN 'remove' WHEN 'purchase' THEN 'favorite' WHEN 'error' THEN 'undo_remove' ELSE 'undo_save' END"


def _kept(add: str, *drop: str) -> str:
    return f"coalesce(arg_max(action, seq) FILTER (action IN {(add, *drop)}) = '{add}', FALSE)"


@query(f"""WITH a AS (SELECT user_id AS video_id, event_id AS seq, {_ACTIONS} AS action, CAST(floor(value) AS BIGINT) % 6 AS idx FROM events),
s AS (SELECT video_id, idx, {_kept('save', 'undo_save', 'remove')} AS saved, {_kept('remove', 'undo_remove', 'save')} AS removed, {_kept('favorite', 'undo_favorite', 'remove')} AS favorited FROM a GROUP BY video_id, idx)
SELECT video_id, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (saved), '') AS saved, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (removed), '') AS removed,
  coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (favorited), '') AS favorited FROM s GROUP BY video_id""")
def review_state(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), F.expr(_ACTIONS).alias("action"), (F.floor("value") % 6).cast("int").alias("idx"))
    return C.review_state(rows).select("video_id", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("saved", "removed", "favorited")])


@query(f"WITH {VIDEOS_SQL} SELECT id, greatest(0.0, duration - 900.0) AS start, least(950.0, duration - 880.0 + id % 5) AS \"end\" FROM videos WHERE id % 2 = 0 AND greatest(0.0, duration - 900.0) < least(950.0, duration - 880.0 + id % 5)")
def trimmed_segments(spark, sf):
    v = videos(spark, sf)
    segments = v.select(F.col("id").alias("video_id"), F.lit(0).alias("seg_idx"), (F.col("duration") - 900).alias("start"), (F.col("duration") - 880).alias("end"))
    trims = v.select(F.col("id").alias("video_id"), F.lit(0).alias("seg_idx"), F.lit(0.0).alias("before"), (F.col("id") % 5).cast("double").alias("after")).where("after > 0")
    saved = v.where("id % 2 = 0").select(F.col("id").alias("video_id"), F.lit(0).alias("seg_idx"))
    return C.apply_trims(segments, trims, saved, F.lit(950.0)).select(F.col("video_id").alias("id"), "start", "end")


@query(f"WITH {VIDEOS_SQL} SELECT id, CASE WHEN is_processed THEN 'processed' ELSE 'saved' END || CASE WHEN folder_path = '' THEN '' ELSE '/' || folder_path END AS folder_path FROM videos")
def split_library(spark, sf):
    return C.split_library(videos(spark, sf)).select("id", "folder_path")


@query(f"WITH {FOLDERS_SQL} SELECT p_type AS parent_path, p_name AS name FROM (SELECT DISTINCT p_type, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_name END AS p_name FROM part) w WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE f.parent_path = w.p_type AND lower(f.name) = lower(w.p_name))")
def free_folder_names(spark, sf):
    p = table(spark, sf, "part")
    wanted = p.select(F.col("p_type").alias("parent_path"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_name")).alias("name")).distinct()
    return C.free_names(wanted, folders(spark, sf)).select("parent_path", "name")


@query(f"WITH {VIDEOS_SQL} SELECT id FROM videos WHERE folder_path = 'ECONOMY' AND (contains(lower(custom_name), 'red') OR contains(file_name, 'red'))")
def search_here(spark, sf):
    return C.search_here(videos(spark, sf), folders(spark, sf), "ECONOMY", "Red")[0].select("id")
