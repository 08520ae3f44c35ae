"""Streams of frames and of changes.

State is kept per key: per video for the decider, per counter for changes.  Where a
function sets a watermark, later rows are dropped by Spark and counted in its progress reports.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.config import Config
from ..operators.decider import Memory, columns_of, decided

def decide(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """video_id, t and is_active of a stream frames(video_id, t, has_ball, is_projectile, ball_y), as soon as they come.

    Frames of a video come in order from micro-batch to micro-batch; within one they
    are sorted here.  State never expires; `live.decide` puts frames in order up to a watermark and forgets silent videos.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, since = json.loads(state.get[0]) if state.exists else (asdict(Memory()), None)
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        active, memory, since = decided(Memory(**memory), since, columns_of(rows), config)
        state.update((json.dumps((asdict(memory), since)),))
        yield pd.DataFrame({"video_id": key[0], "t": rows.t.to_numpy(), "is_active": active})

    rows = frames.select("video_id", F.col("t").cast("double").alias("t"), "has_ball", "is_projectile", F.col("ball_y").cast("double").alias("ball_y"))
    kind = rows.schema["video_id"].dataType.simpleString()
    return rows.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, t double, is_active boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_rate(events: DataFrame, ts: str, key: str, flag: str, length: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Flagged rows per sliding window and key, final once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step), key).agg(F.count_if(F.col(flag)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def counters(changes: DataFrame, key: str) -> DataFrame:
    """Running counts of a stream changes(key, delta); write it in update mode."""
    return changes.groupBy(key).agg(F.sum("delta").alias("n"))


def into_table(batches: DataFrame, path: str, checkpoint: str, key: str, name: str):
    """Keep a Parquet table of counters from a stream of changes; a batch that is repeated counts once.

    Each micro-batch becomes one part of sums by key, named by its number, so replay
    writes the same part again; `counter_table` adds the parts up, and `compact` puts them together.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.sum("delta").alias(name)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished folders of `path`, by kind: base or batch."""
    found: dict[str, list[int]] = {"base": [], "batch": []}
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        for status in files.listStatus(place):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return found


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> tuple[list[str], int]:
    """The folders that make up the table, and the number of the last batch among them: the last base, and batches after it."""
    found = _folders(spark, path)
    base = max((n for n in found["base"] if upto is None or n <= upto), default=-1)
    later = sorted(n for n in found["batch"] if n > base and (upto is None or n <= upto))
    return [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in later], max([base, *later])


def counter_table(spark: SparkSession, path: str, key: str, name: str, clamp: bool = True) -> DataFrame:
    """Sums by key.  A batch that the base already holds does not count again, even if it is written again."""
    summed = spark.read.parquet(*_parts(spark, path)[0]).groupBy(key).agg(F.sum(name).alias(name))
    return summed.withColumn(name, F.greatest(F.lit(0), F.col(name))) if clamp else summed


def compact(spark: SparkSession, path: str, key: str, name: str, upto: int | None = None) -> int:
    """Write one base of all batches up to a number, and give that number; `sweep` removes what it replaces.

    The base counts from the moment it is finished, so a compaction that ends half-way changes nothing.
    """
    parts, last = _parts(spark, path, upto)
    if len(parts) > 1:
        spark.read.parquet(*parts).groupBy(key).agg(F.sum(name).alias(name)).write.mode("overwrite").parquet(f"{path}/base={last}")
    return last


def sweep(spark: SparkSession, path: str) -> None:
    """Remove the batches and bases that the last base holds; readers that began before it must have ended."""
    found = _folders(spark, path)
    base = max(found["base"], default=-1)
    for kind, numbers in found.items():
        for n in numbers:
            if n < base or kind == "batch" and n == base:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}")
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def nearest_within(probes: DataFrame, rows: DataFrame, key: str, order: str, tolerance: str, probe_id: str, late: str = "10 minutes", nearest: bool = True) -> DataFrame:
    """Of two streams (key, ts, ...): for each probe the `order` of the row nearest in time within the tolerance, or else the least.

    Both have a watermark, and the time between them is bounded, so either side's rows are dropped once
    nothing can meet them; a probe comes out when the watermark has passed it.  Ties go to the least `order`.
    Probes that meet nothing do not come out.
    """
    p = probes.select(F.col(key).alias("p_key"), F.col("ts").alias("p_ts"), probe_id).withWatermark("p_ts", late)
    r = rows.select(F.col(key).alias("r_key"), F.col("ts").alias("r_ts"), F.col(order).alias("r_order")).withWatermark("r_ts", late)
    span = F.expr(f"interval {tolerance}")
    near = p.join(r, (F.col("p_key") == F.col("r_key")) & (F.col("r_ts") >= F.col("p_ts") - span) & (F.col("r_ts") <= F.col("p_ts") + span))
    gap = F.abs(F.unix_micros("r_ts") - F.unix_micros("p_ts")) if nearest else F.lit(0)
    best = near.groupBy(probe_id, "p_ts").agg(F.min(F.struct(gap.alias("gap"), "r_order")).alias("best"))
    return best.select(probe_id, F.col("p_ts").alias("ts"), F.col("best.r_order").alias(order))


def drain(queue: DataFrame, send, checkpoint: str, retry_path: str):
    """Hand each micro-batch to `send`, a function that gives the rows it could not take; those wait in a table, in order.

    At least once: a batch that is repeated is sent again.
    """

    def run(batch: DataFrame, number: int) -> None:
        send(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{retry_path}/batch={number}")

    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
