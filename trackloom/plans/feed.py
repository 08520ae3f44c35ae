"""Feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import social as S
from .roles import FOLLOWS_SQL, follows, highlights, profiles, query, table


@query("SELECT o_orderkey AS id, o_custkey AS author_id, c_name AS author_name, c_mktsegment AS author_segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def feed_page(spark, sf):
    shown = S.with_author(S.newest(highlights(spark, sf)), profiles(spark, sf))
    return shown.select("id", "author_id", F.col("author.username").alias("author_name"), F.col("author.segment").alias("author_segment"))


@query(f"WITH {FOLLOWS_SQL} SELECT o_orderkey AS id, o_custkey AS author_id FROM orders WHERE o_custkey IN (SELECT following_id FROM follows WHERE follower_id = 5) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def following_feed(spark, sf):
    return S.following_feed(highlights(spark, sf), follows(spark, sf), 5, number=1).select("id", "author_id")


@query("SELECT id, author_id FROM (SELECT o_orderkey AS id, o_custkey AS author_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) WHERE author_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def feed_minus_blocked(spark, sf):
    blocks = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.lit(1).alias("blocker_id"), F.col("c_custkey").alias("blocked_id"))
    return S.without_blocked(S.newest(highlights(spark, sf)), blocks, 1).select("id", "author_id")


@query("""SELECT o_orderkey AS id, count(l_orderkey) AS n_options, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS options
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 5 = 0 GROUP BY o_orderkey""")
def nested_embed(spark, sf):
    polls = highlights(spark, sf).where("id % 5 = 0").select("id", F.col("id").alias("highlight_id"))
    options = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("poll_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("id"))
    shown = S.with_poll(highlights(spark, sf).select("id"), polls, options)
    listed = F.transform("poll.options", lambda o: F.concat_ws(":", o["sort_order"].cast("string"), o["id"].cast("string")))
    return shown.select("id", F.greatest(F.coalesce(F.size("poll.options"), F.lit(0)), F.lit(0)).cast("long").alias("n_options"), F.coalesce(F.array_join(listed, ","), F.lit("")).alias("options"))


@query("SELECT p_partkey AS id, p_name AS caption FROM part WHERE p_name ILIKE '%ring%' OR p_type = 'ring' OR p_brand = 'ring' OR p_brand ILIKE '%ring%'")
def search_or_ilike(spark, sf):
    posts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("caption"), F.array("p_type", "p_brand").alias("tags"), F.col("p_brand").alias("location_name"))
    return S.search_highlights(posts, '(r,i"n}g').select("id", "caption")


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_name ILIKE '%r#0000_001%' ORDER BY c_custkey LIMIT 20")
def search_people(spark, sf):
    return S.search_people(profiles(spark, sf), "R#0000_001").select("id", "username")


@query("WITH l AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT tag, count(*) AS count FROM (SELECT o_orderpriority AS tag FROM l UNION ALL SELECT o_orderstatus FROM l) GROUP BY tag ORDER BY count DESC, tag LIMIT 12")
def trending_terms(spark, sf):
    return S.trending(highlights(spark, sf))


@query("SELECT p_partkey AS id, array_to_string(list_transform(regexp_extract_all('#' || replace(p_name, ' ', ' #') || ' #' || p_type, '#(\\w+)', 1), lambda x: lower(x)), ',') AS tags FROM part")
def hashtag_extract(spark, sf):
    caption = F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit(" #")), F.lit(" #"), F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.hashtags(caption), ",").alias("tags"))


@query(f"WITH {FOLLOWS_SQL} SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey IN (SELECT follower_id FROM follows WHERE following_id = 20)")
def follower_list(spark, sf):
    return S.people(follows(spark, sf), profiles(spark, sf), 20, followers=True).select("id", "username")


@query(f"WITH {FOLLOWS_SQL} SELECT c_custkey AS id, c_custkey IN (SELECT following_id FROM follows WHERE follower_id = 5) AS is_following FROM customer")
def follow_status(spark, sf):
    return S.is_following(profiles(spark, sf).select("id"), follows(spark, sf), 5)


@query("SELECT o_orderkey AS poll_id, l_linenumber AS my_option FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = 7")
def my_votes(spark, sf):
    votes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("poll_id"), F.col("l_linenumber").alias("option_id"), F.col("l_suppkey").alias("user_id"))
    return S.my_votes(highlights(spark, sf).select(F.col("id").alias("poll_id")), votes, 7)


@query("""SELECT o_orderkey AS id, count(l_orderkey) AS comments_count, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS BIGINT) AS likes_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def counters_recount(spark, sf):
    lines = table(spark, sf, "lineitem")
    counted = S.recount(highlights(spark, sf).select("id"), "id", lines, "l_orderkey", "comments_count")
    return S.recount(counted, "id", lines.where("l_returnflag = 'R'"), "l_orderkey", "likes_count")


@query("SELECT o_orderkey AS id, greatest(0, 2 + CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_orderkey IS NOT NULL THEN 1 END), 0) AS BIGINT)) AS likes_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def counters_changed(spark, sf):
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta"))
    return S.apply_changes(highlights(spark, sf).select("id", F.lit(2).cast("long").alias("likes_count")), changes, "id", "likes_count")


_FLAGS = "flags AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS local_video_id, event_id AS seq, 'r' || CAST(event_id AS VARCHAR) AS reason, CAST(floor(value) AS BIGINT) % 3 AS k FROM events)"


@query(f"""WITH {_FLAGS} SELECT user_id, local_video_id, arg_min(reason, seq) AS reason, CAST(sum(greatest(k, 1)) AS BIGINT) AS flag_count, CAST(sum(k) AS BIGINT) AS n_events FROM flags WHERE local_video_id IS NOT NULL GROUP BY user_id, local_video_id
UNION ALL SELECT user_id, local_video_id, reason, greatest(k, 1), k FROM flags WHERE local_video_id IS NULL""")
def upsert_increment(spark, sf):
    k = (F.floor("value") % 3).cast("int")
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("local_video_id"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reason"), F.array_repeat(F.lit("e"), k).alias("events"))
    return S.record_flags(e).select("user_id", "local_video_id", "reason", "flag_count", F.size("flag_events").cast("long").alias("n_events"))


@query("SELECT o_orderkey AS id, 'delete' AS verb FROM orders WHERE o_custkey = 11 UNION ALL SELECT c_custkey, 'update' FROM customer WHERE c_custkey = 11 UNION ALL SELECT c_custkey, 'select' FROM customer")
def rls_visible_rows(spark, sf):
    h, p = highlights(spark, sf), profiles(spark, sf)
    parts = [S.secure(h, "highlights", "delete", 11).select("id", F.lit("delete").alias("verb")), S.secure(p, "profiles", "update", 11).select("id", F.lit("update").alias("verb")), S.secure(p, "profiles", "select", 11).select("id", F.lit("select").alias("verb")), S.secure(h, "content_reports", "delete", 11).select("id", F.lit("delete").alias("verb"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT l_orderkey AS poll_id, l_linenumber AS sort_order, l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11 AND o_orderkey % 2 = 0")
def rls_poll_options(spark, sf):
    h = highlights(spark, sf)
    polls = h.where("id % 2 = 0").select("id", F.col("id").alias("highlight_id"))
    options = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("poll_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("id"))
    return S.secure(options, "poll_options", "insert", 11, h, polls).select("poll_id", "sort_order", "id")


@query(f"WITH {FOLLOWS_SQL} SELECT c_custkey AS blocker_id, c_custkey + 1 AS blocked_id, EXISTS (SELECT 1 FROM follows WHERE follower_id = c_custkey AND following_id = c_custkey + 1) AS is_blocked FROM customer")
def block_checks(spark, sf):
    blocks = follows(spark, sf).select(F.col("follower_id").alias("blocker_id"), F.col("following_id").alias("blocked_id"))
    return S.is_blocked(blocks, profiles(spark, sf).select(F.col("id").alias("blocker_id"), (F.col("id") + 1).alias("blocked_id")))


@query("""SELECT 'highlights' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'comments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)
UNION ALL SELECT 'profiles', count(*) FROM customer WHERE c_custkey % 10 <> 3""")
def cascade_delete(spark, sf):
    tables = {"profiles": profiles(spark, sf), "highlights": highlights(spark, sf), "comments": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("highlight_id"))}
    links = [("profiles", "id", "highlights", "author_id"), ("highlights", "id", "comments", "highlight_id")]
    left = S.cascade(tables, "profiles", profiles(spark, sf).where("id % 10 = 3").select("id"), links)
    out = None
    for name, rows in left.items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT count(*) AS n_rows, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 2 = 0) AS n_refused FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey FROM orders)")
def insert_unique(spark, sf):
    known = profiles(spark, sf).where("id % 2 = 0").select("id")
    table_, refused = S.insert_new(known, highlights(spark, sf).select(F.col("author_id").alias("id")), "id")
    both = table_.select(F.lit(1).alias("n_rows"), F.lit(0).alias("n_refused")).union(refused.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_refused").alias("n_refused"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS username FROM customer FULL JOIN (SELECT s_suppkey + 3 AS s_suppkey, s_name FROM supplier) ON s_suppkey = c_custkey")
def upsert_profiles(spark, sf):
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 3).alias("id"), F.col("s_name").alias("username"))
    return S.upsert(profiles(spark, sf).select("id", "username"), new, "id", ["username"])


@query("SELECT l_orderkey AS poll_id, l_linenumber AS id, CAST(floor(l_quantity / s * 100) AS INTEGER) AS percent FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)")
def poll_shares(spark, sf):
    from pyspark.sql import Window

    from ..functions.numeric import poll_percent

    lines = table(spark, sf, "lineitem")
    return lines.select(F.col("l_orderkey").alias("poll_id"), F.col("l_linenumber").alias("id"), poll_percent(F.col("l_quantity"), F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("percent"))


@query(f"WITH {FOLLOWS_SQL}, f AS (SELECT follower_id, CASE WHEN follower_id % 9 = 0 THEN follower_id ELSE following_id END AS following_id FROM follows) SELECT follower_id, following_id, 'no_self_follow' AS broken FROM f WHERE follower_id = following_id")
def check_violations(spark, sf):
    rows = follows(spark, sf).withColumn("following_id", F.when(F.col("follower_id") % 9 == 0, F.col("follower_id")).otherwise(F.col("following_id")))
    return S.violations(rows, S.checks_of("follows"))[1].select("follower_id", "following_id", F.array_join("broken", ",").alias("broken"))
