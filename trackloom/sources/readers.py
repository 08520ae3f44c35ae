"""Readers of documents, manifests and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S


def _json(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def documents(spark: SparkSession, path: str, suffix: str = "_metadata.json") -> tuple[DataFrame, DataFrame]:
    """Good documents, and those that are corrupt or whose video id is not their file's, with a reason.

    Files with another suffix, such as backups, are not read.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){suffix.replace('.', '[.]')}$", 1)
    rows = _json(spark, path, S.DOCUMENT, f"*{suffix}").withColumn("file_stem", stem)
    reason = F.when(F.col("corrupt").isNotNull() | F.col("videoId").isNull(), "corrupt").when(F.lower("videoId") != F.lower("file_stem"), "wrong video")
    judged = rows.withColumn("reason", reason).fillna(S.DOCUMENT_DEFAULTS)
    return judged.where("reason is null").drop("reason", "corrupt", "file_stem"), judged.where("reason is not null").select("file_stem", "reason")


def document_ids(spark: SparkSession, path: str, suffix: str = "_metadata.json") -> DataFrame:
    """Video ids by the names of files alone; contents are not read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return names.select(F.regexp_extract("path", f"([^/]*){suffix.replace('.', '[.]')}$", 1).alias("video_id"))


def segments(docs: DataFrame) -> DataFrame:
    """One row per segment of each document, with its duration."""
    flat = docs.select(F.col("videoId").alias("video_id"), F.posexplode("rallySegments").alias("seg_idx", "s"))
    return flat.select("video_id", "seg_idx", "s.*").withColumn("duration", F.col("endTime") - F.col("startTime"))


def document_metrics(docs: DataFrame) -> DataFrame:
    """Count, total and mean duration of each document's segments; 0 without any."""
    total = F.aggregate(F.coalesce("rallySegments", F.expr("array()").cast(docs.schema["rallySegments"].dataType)), F.lit(0.0), lambda a, s: a + s["endTime"] - s["startTime"])
    n = F.coalesce(F.size("rallySegments"), F.lit(0))
    return docs.select(F.col("videoId").alias("video_id"), F.greatest(n, F.lit(0)).alias("n_segments"), total.alias("total_duration")).withColumn("mean_duration", F.when(F.col("n_segments") > 0, F.col("total_duration") / F.col("n_segments")).otherwise(0.0))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos, folders and the paths of manifests that cannot be read; the latter count as empty."""
    rows = _json(spark, path, S.MANIFEST).withColumn("path", F.col("_metadata.file_path"))
    good, bad = rows.where("corrupt is null"), rows.where("corrupt is not null and version is null").select("path")
    when = lambda c: F.timestamp_seconds(F.col(c) + S.REFERENCE_DATE)
    v = good.select(F.explode("videos").alias("file_name", "v")).select(
        F.lower("v.id").alias("id"),
        "file_name",
        F.col("v.customName").alias("custom_name"),
        F.coalesce("v.folderPath", F.lit("")).alias("folder_path"),
        when("v.createdDate").alias("created_date"),
        F.col("v.fileSize").alias("file_size"),
        F.col("v.duration").alias("duration"),
        F.coalesce("v.isProcessed", F.lit(False)).alias("is_processed"),
        F.coalesce("v.hasProcessingMetadata", F.lit(False)).alias("has_processing_metadata"),
        F.lower("v.originalVideoId").alias("original_video_id"),
        F.transform(F.coalesce("v.processedVideoIds", F.array().cast("array<string>")), F.lower).alias("processed_video_ids"),
    )
    f = good.select(F.explode("folders").alias("path", "f")).select("path", F.col("f.name").alias("name"), F.col("f.parentPath").alias("parent_path"), when("f.createdDate").alias("created_date"), when("f.modifiedDate").alias("modified_date"))
    return v, f, bad


def trims(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, seg_idx, ...) of sidecars that map a segment's index to its trim."""
    inner = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in S.TRIM.split(", "))
    rows = _json(spark, path, f"videoId string, trims map<string,struct<{inner}>>, corrupt string").where("corrupt is null")
    flat = rows.select(F.col("videoId").alias("video_id"), F.explode("trims").alias("seg_idx", "t"))
    return flat.select("video_id", F.col("seg_idx").cast("int").alias("seg_idx"), "t.*").fillna(S.TRIM_DEFAULTS)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Stored frame evidence with flat points; one file per video, named by its id."""
    rows = spark.read.schema(f"{S.EVIDENCE}").json(path).withColumn("video_id", F.regexp_extract(F.col("_metadata.file_name"), "^([^.]*)", 1))
    return rows.select("video_id", F.col("time").alias("t"), F.col("hasBall").alias("has_ball"), F.col("isProjectile").alias("is_projectile"), F.col("trackY").alias("ball_y"), F.col("trackX").alias("track_x"), "detections", F.col("rSquared").alias("r2"), F.col("movementType").alias("movement_type"), F.col("rejectionReason").alias("rejection_reason"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, S.LABELS + ", corrupt string").where("corrupt is null")
    return rows.select(F.col("videoId").alias("video_id"), F.posexplode("labels").alias("seg_idx", "l")).select("video_id", "seg_idx", "l.start", "l.end")


def flatten_results(rows: DataFrame) -> DataFrame:
    """(name, status) of a test tree: rows(name, status, children json array), however deep.

    A parent without a status gives its name as a prefix to its children.
    """
    node = "array<struct<name:string,status:string,children:string>>"
    level, out = rows.select("name", "status", "children"), None
    while out is None or not level.isEmpty():
        leaves = level.where("status is not null").select("name", "status")
        out = leaves if out is None else out.unionByName(leaves)
        below = level.where("children is not null").select(F.col("name").alias("prefix"), F.explode(F.from_json("children", node)).alias("c"))
        level = below.select(F.concat_ws("/", "prefix", "c.name").alias("name"), "c.status", "c.children")
    return out
