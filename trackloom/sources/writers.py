"""Writers; each relies on the commit of Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(rows: DataFrame, path: str, key: str = "videoId") -> None:
    """JSON documents; a video's old documents are replaced, those of others stay."""
    rows.withColumn("key", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(path)


def sidecar(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("overwrite").format(kind).save(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def debug_table(points: DataFrame, quality: DataFrame, kinds: DataFrame, physics: DataFrame) -> DataFrame:
    """Points(trajectory_id, t, x, y, vx, vy, confidence) with the first quality, kind and verdict of their trajectory; 0, unknown and false without.

    quality(trajectory_id, seq, score, smoothness), kinds(…, movement_type), physics(…, is_valid).
    """
    first = lambda df, c: df.groupBy("trajectory_id").agg(*[F.min_by(x, "seq").alias(x) for x in c])
    joined = points
    for df, c in ((quality, ["score", "smoothness"]), (kinds, ["movement_type"]), (physics, ["is_valid"])):
        joined = joined.join(first(df, c), "trajectory_id", "left")
    return joined.fillna({"score": 0.0, "smoothness": 0.0, "movement_type": "unknown", "is_valid": False})


def debug_bundle(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): all rows of a key as one JSON array."""
    return rows.groupBy(key).agg(F.to_json(F.collect_list(F.struct("*"))).alias("json"))


def status_changes(results: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items(item_id, automation_id, status) whose status changes by results(name, status), and results without an item."""
    status = F.when(F.col("r.status") == "Passed", "pass").when(F.col("r.status") == "Failed", "fail").otherwise("skip")
    joined = results.alias("r").join(items.alias("i"), F.col("r.name") == F.col("i.automation_id"))
    changed = joined.select("i.item_id", F.col("i.status").alias("before"), status.alias("after")).where("not before <=> after")
    return changed, results.join(items.select(F.col("automation_id").alias("name")), "name", "left_anti")
