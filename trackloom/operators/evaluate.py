"""Scoring segments against labels, replay, parameter sweeps and comparison of pipelines."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from . import intervals, replays, stateful
from .config import Config
from .settled import settled

#: Fixed ranges of the swept parameters.
BOUNDS = {"start_buffer": (0.0, 1.5), "end_timeout": (0.3, 3.0), "grace_frames": (0.0, 8.0), "min_active_sec": (0.5, 6.0), "merge_gap": (0.0, 2.0), "min_length": (0.0, 4.0)}
DRIFT_WEIGHT, NEAR, TOP = 0.06, 0.05, 5
#: Parameter rows in one sweep, and those that one task replays for a video.
MAX_PARAMETERS, CHUNK = 5000, 50


def greedy_match(pairs: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """One-to-one matches by falling IoU; ties by the predicted, then the true segment's index.

    In rounds: a pair that is the best of both its segments is one that greedy choice
    keeps, whatever else is there.  All such pairs of all keys are kept at once, and pairs with a
    segment that is taken go; until none is left.  The best pair of what is left always is one, and
    rounds are as many as pairs that wait for each other in a chain.  Each round's rest
    is checkpointed where the session names a folder for that, else persisted.
    """
    order = [F.desc("iou"), "p_idx", "t_idx"]
    kept, rest = None, settled(pairs)
    while not rest.isEmpty():
        ranked = rest
        for side in ("p_idx", "t_idx"):
            ranked = ranked.withColumn(f"best_{side}", F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order)) == 1)
        best = settled(ranked.where("best_p_idx and best_t_idx").select(*pairs.columns))
        kept = best if kept is None else kept.unionByName(best)
        for side in ("p_idx", "t_idx"):
            taken = best.select(*[F.col(c).alias(f"taken_{c}") for c in (*keys, side)])
            rest = rest.join(taken, [F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in (*keys, side)], "left_anti")
        rest = settled(rest)
    return rest if kept is None else kept


def score(predicted: DataFrame, truth: DataFrame, matches: DataFrame, keys: tuple[str, ...] = (), tolerance: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1, boundary errors and the sweep's objective, per `keys` or pooled over all.

    Pooled scores add up counts and errors; they are not means of scores.  Empty
    denominators give 0.
    """
    start, end = F.abs(F.col("start") - F.col("r_start")), F.abs(F.col("end") - F.col("r_end"))
    one = lambda name: F.lit(1).cast("long").alias(name)
    hits = matches.select(*keys, one("tp"), start.alias("start_err"), end.alias("end_err"), (start <= tolerance).cast("long").alias("start_in"), (end <= tolerance).cast("long").alias("end_in"))
    rows = predicted.select(*keys, one("n_pred")).unionByName(truth.select(*keys, one("n_true")), allowMissingColumns=True).unionByName(hits, allowMissingColumns=True)
    names = ("n_pred", "n_true", "tp", "start_in", "end_in", "start_err", "end_err")
    return scores(rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]), keys)


def scores(whole: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What `score` gives, from counts and sums of errors."""
    tp = F.col("tp").cast("double")
    out = whole.select(
        *keys,
        "tp",
        (F.col("n_pred") - F.col("tp")).alias("fp"),
        (F.col("n_true") - F.col("tp")).alias("fn"),
        ratio(tp, F.col("n_pred").cast("double")).alias("precision"),
        ratio(tp, F.col("n_true").cast("double")).alias("recall"),
        *[ratio(F.col(f"{c}_err").cast("double"), tp).alias(f"{c}_mae") for c in ("start", "end")],
        *[ratio(F.col(f"{c}_in").cast("double"), tp).alias(f"{c}_within") for c in ("start", "end")],
    )
    p_, r_ = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", ratio(2 * p_ * r_, p_ + r_))
    return out.withColumn("objective", 0.75 * F.col("f1") + 0.25 * (F.col("start_within") + F.col("end_within")) / 2)


def replay(evidence: DataFrame, config: Config, padded: bool = True, duration: DataFrame | None = None) -> DataFrame:
    """Segments of stored evidence under other parameters; unpadded leaves out the time before and after."""
    active = stateful.decide(evidence, config)
    used = config if padded else Config(**{**config.__dict__, "preroll": 0.0, "short_preroll": 0.0, "postroll": 0.0})
    return intervals.build(active, duration=duration, config=used)


def draw_parameters(spark: SparkSession, anchor: dict[str, float], n: int, seed: int, around: dict[str, float] | None = None, spread: float = 0.08, first_id: int = 0) -> DataFrame:
    """The anchor and n drawn parameter rows: uniform in the bounds, or within `spread` of the spans around one."""
    rows = spark.range(first_id, first_id + n).withColumnRenamed("id", "param_id")
    # Drawn from the row's own number, so that the draw does not follow partitions.
    draw = lambda k: (F.shiftrightunsigned(F.xxhash64("param_id", F.lit(seed), F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
    for k, (name, (low, high)) in enumerate(BOUNDS.items()):
        if around is None:
            v = F.lit(low) + draw(k) * (high - low)
        else:
            v = F.greatest(F.lit(low), F.least(F.lit(high), F.lit(around[name]) + (draw(k) * 2 - 1) * (high - low) * spread))
        rows = rows.withColumn(name, v)
    if around is not None:
        return rows
    return rows.unionByName(spark.createDataFrame([(-1, *[float(anchor[k]) for k in BOUNDS])], "param_id long, " + ", ".join(f"{k} double" for k in BOUNDS)))


def evaluate_parameters(evidence: DataFrame, truth: DataFrame, params: DataFrame, anchor: dict[str, float]) -> DataFrame:
    """params with f1, objective, drift from the anchor and rank_score.

    Parameters are at most `MAX_PARAMETERS` rows, which is checked; they travel with
    the tasks.  Each video is dealt out with its labels once per `CHUNK` parameters, so (videos x
    chunks) run side by side; matches are greedy as in `greedy_match`, and a task hands on its sums only.
    """
    base = Config()
    listed = [r.asDict() for r in params.limit(MAX_PARAMETERS + 1).collect()]
    if len(listed) > MAX_PARAMETERS:
        raise ValueError(f"a sweep takes at most {MAX_PARAMETERS} parameter rows")
    rows = evidence.where("t is not null").select("video_id", F.struct(F.col("t").cast("double").alias("t"), *[F.col(c).cast("boolean").alias(c) for c in ("has_ball", "is_projectile")], F.col("ball_y").cast("double").alias("ball_y")).alias("frame"))
    by_video = rows.groupBy("video_id").agg(F.array_sort(F.collect_list("frame")).alias("frames")).select("video_id", *[F.col(f"frames.{c}").alias(c) for c in ("t", "has_ball", "is_projectile", "ball_y")])
    labels = truth.groupBy(F.col("video_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "seg_idx"))).alias("labels"))
    labelled = by_video.join(labels, F.col("video_id").eqNullSafe(F.col("of")), "left").select("video_id", "t", "has_ball", "is_projectile", "ball_y", *[F.col(f"labels.{c}").alias(c) for c in ("seg_idx", "start", "end")])
    fanned = labelled.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((len(listed) - 1) // CHUNK)))).repartition("video_id", "chunk").drop("video_id")

    def run(batches):
        sums = {}
        for batch in batches:
            chunk = batch.column("chunk")
            for c in chunk.unique().to_pylist():
                own = replays.replayed(batch.filter(pc.equal(chunk, c)), listed[c * CHUNK : (c + 1) * CHUNK], base)
                sums[c] = {k: v + sums[c][k] for k, v in own.items()} if c in sums else own
        for c, own in sums.items():
            ids = [r["param_id"] for r in listed[c * CHUNK : (c + 1) * CHUNK]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(own[k]) for k in replays.SUMS]], ["param_id", *replays.SUMS])

    found = fanned.mapInArrow(run, "param_id long, " + ", ".join(f"{c} double" for c in replays.SUMS)).groupBy("param_id").agg(*[F.sum(c).alias(c) for c in replays.SUMS])
    whole = params.select("param_id").join(found, "param_id", "left").fillna(0.0).crossJoin(truth.agg(F.count("*").cast("double").alias("n_true")))
    scored = scores(whole, ("param_id",)).select("param_id", "f1", "objective")
    drift = sum((F.abs(F.col(k) - float(anchor[k])) / max(1e-9, high - low) for k, (low, high) in BOUNDS.items()), F.lit(0.0)) / len(BOUNDS)
    full = params.join(scored, "param_id", "left").fillna(0.0, ["f1", "objective"]).withColumn("drift", drift)
    return full.withColumn("rank_score", F.col("objective") - DRIFT_WEIGHT * F.col("drift"))


def distinct_top(evaluated: DataFrame, top: int = TOP) -> list[dict]:
    """The best parameter rows, leaving out any that is near a better one in every parameter; a report of a few rows."""
    best: list[dict] = []
    for row in evaluated.orderBy(F.desc("rank_score"), "param_id").toLocalIterator():
        own = row.asDict()
        if not any(all(abs(own[k] - b[k]) / (high - low) < NEAR for k, (low, high) in BOUNDS.items()) for b in best):
            best.append(own)
        if len(best) >= top:
            break
    return best


def sweep(evidence: DataFrame, truth: DataFrame, anchor: dict[str, float], wide: int = 600, local: int = 400, seed: int = 1) -> list[dict]:
    """Draw widely, then around the best, and report the top few."""
    spark = evidence.sparkSession
    first = evaluate_parameters(evidence, truth, draw_parameters(spark, anchor, wide, seed), anchor).persist()
    best = first.orderBy(F.desc("rank_score"), "param_id").first().asDict()
    second = evaluate_parameters(evidence, truth, draw_parameters(spark, anchor, local, seed + 100, {k: best[k] for k in BOUNDS}, first_id=wide), anchor)
    out = distinct_top(first.unionByName(second))
    first.unpersist()
    return out


def compare(pipelines: dict[str, Callable[[DataFrame], DataFrame]], source: DataFrame, truth: DataFrame) -> DataFrame:
    """The pooled score of each pipeline, by name."""
    out = None
    for name, pipeline in pipelines.items():
        found = pipeline(source)
        matches = greedy_match(intervals.iou_pairs(found, truth))
        own = score(found, truth, matches).withColumn("pipeline", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
