"""The driver's tables in the roles that the operators know, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOURS = "(epoch_us(ts) - 1704067200000000) / 3600000000.0"
ACTIVE = "event_type IN ('view', 'click', 'purchase')"
FRAMES_SQL = f"frames AS (SELECT event_id, user_id AS video_id, {HOURS} AS t, {ACTIVE} AS is_active, event_type, value FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video_id, t, is_active, event_type, value."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 3600000000D")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), hours.alias("t"), F.col("event_type").isin("view", "click", "purchase").alias("is_active"), "event_type", "value")


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), "o_totalprice")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everybody follows three others."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("follower_id"))
    return c.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("follower_id", ((F.col("follower_id") * 7 + F.col("k") * 13) % 100).alias("following_id")).where("follower_id <> following_id").distinct()


FOLLOWS_SQL = "follows AS (SELECT DISTINCT follower_id, following_id FROM (SELECT c_custkey AS follower_id, (c_custkey * 7 + k * 13) % 100 AS following_id FROM customer, (VALUES (1), (2), (3)) AS x(k)) WHERE follower_id <> following_id)"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as videos: every third is a processed copy of the one before it."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("id"),
        F.concat(F.lower("p_brand"), F.lit("."), F.when(key % 2 == 0, "mov").otherwise("mp4")).alias("file_name"),
        F.col("p_name").alias("custom_name"),
        F.when(key % 7 == 0, "").when(key % 7 < 4, F.col("p_type")).otherwise(F.concat("p_type", F.lit("/"), "p_brand")).alias("folder_path"),
        (F.col("p_size").cast("long") * 41_943_040).alias("file_size"),
        F.col("p_retailprice").alias("duration"),
        (key % 3 == 2).alias("is_processed"),
        F.when(key % 3 == 2, key - 1).alias("original_video_id"),
        F.expr("timestampadd(DAY, cast(p_partkey % 400 as int), timestamp_ntz'2023-06-01 00:00:00')").alias("created_date"),
    )


VIDEOS_SQL = """videos AS (SELECT p_partkey AS id, lower(p_brand) || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'mov' ELSE 'mp4' END AS file_name, p_name AS custom_name,
    CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 < 4 THEN p_type ELSE p_type || '/' || p_brand END AS folder_path,
    CAST(p_size AS BIGINT) * 41943040 AS file_size, p_retailprice AS duration, p_partkey % 3 = 2 AS is_processed,
    CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 1 END AS original_video_id,
    TIMESTAMP '2023-06-01' + to_days(CAST(p_partkey % 400 AS INTEGER)) AS created_date FROM part)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    top = p.select(F.col("p_type").alias("path"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parent_path"))
    return top.distinct().unionByName(p.select(F.concat("p_type", F.lit("/"), "p_brand").alias("path"), F.col("p_brand").alias("name"), F.col("p_type").alias("parent_path")))


FOLDERS_SQL = "folders AS (SELECT DISTINCT p_type AS path, p_type AS name, CAST(NULL AS VARCHAR) AS parent_path FROM part UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_brand, p_type FROM part)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three moving boxes a frame, made from the events of a user: 30 frames a second."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "value")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id"))
    e = e.withColumn("frame_idx", n.cast("long")).withColumn("t", n / 30.0).withColumn("det_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    s = F.col("t") % 2.0
    x = F.when(F.col("det_idx") == 0, 0.1 + 0.35 * s).when(F.col("det_idx") == 1, 0.7).otherwise((F.col("value") % 97) / 97)
    y = F.when(F.col("det_idx") == 0, 0.3 + 0.9 * s - 0.45 * s * s).when(F.col("det_idx") == 1, 0.2).otherwise((F.col("value") % 89) / 89)
    return e.select("video_id", "frame_idx", "t", "det_idx", x.alias("x"), y.alias("y"), F.lit(0.03).alias("w"), F.lit(0.03).alias("h"), (0.95 - 0.1 * F.col("det_idx")).alias("conf"))
