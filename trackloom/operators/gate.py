"""The physics gate and the movement types, as columns over a track's recent points.

`points` is an array of struct(t, x, y) in the order of t; see
`functions.numeric`.  Over all points of many tracks, `validate_windows` makes no arrays; see `windows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import windows
from .config import Config


def recent_points(track_points: DataFrame, config: Config = Config(), key: str = "track_id") -> DataFrame:
    """track_points(key, t, x, y) with `points`, the window of the gate, and `loop_points`, that of the loop test.

    Windows count whole ticks of 1/600 of a unit of time, as their source does.
    """
    tick = F.round(F.col("t") * 600).cast("long")
    point = F.struct(F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    over = lambda span: Window.partitionBy(key).orderBy("tick").rangeBetween(-round(span * 600), 0)
    ticked = track_points.withColumn("tick", tick)
    return ticked.withColumns({"points": F.array_sort(F.collect_list(point).over(over(max(0.1, config.window_sec)))), "loop_points": F.array_sort(F.collect_list(point).over(over(config.loop_window_sec)))}).drop("tick")


def motion_details(points: Column, config: Config = Config()) -> dict[str, Column]:
    """The five measures of a trajectory."""
    n = F.size(points)
    # A fit without a defined r2 counts as a perfect one here, as clamping does.
    share = lambda r2: F.when(F.isnan(r2), F.lit(1.0)).otherwise(N.clamp(r2))
    pull = lambda fit: F.when(fit.isNotNull(), F.least(F.lit(1.0), F.abs(fit["a"]) / max(1e-6, config.gravity_curvature)) * share(fit["r2"])).otherwise(F.lit(0.0))
    return {
        "inconsistency": F.when(n < 3, F.lit(1.0)).otherwise(N.cv_capped(N.speeds(points))),
        "acceleration": F.when(n >= 4, N.let(N.quadratic_fit(points), pull)).otherwise(F.lit(0.0)),
        "smoothness": N.turning_smoothness(points),
        "vertical": N.vertical_score(points),
        "span": F.coalesce(F.element_at(points, -1)["t"] - F.get(points, F.lit(0))["t"], F.lit(0.0)),
    }


def physics_score(m: dict[str, Column]) -> Column:
    """The mean of steadiness, pull, smoothness and vertical motion."""
    return ((1 - m["inconsistency"]) + m["acceleration"] + m["smoothness"] + m["vertical"]) / 4


def movement_type(m: dict[str, Column], n: Column, config: Config = Config()) -> Column:
    c = config
    airborne = (physics_score(m) >= c.airborne_physics) & (m["acceleration"] >= c.airborne_acceleration) & (m["smoothness"] >= c.airborne_smoothness)
    rolling = (m["vertical"] < c.rolling_vertical) & (m["smoothness"] >= c.rolling_smoothness) & (m["acceleration"] < c.rolling_acceleration) & (m["inconsistency"] < c.carried_inconsistency)
    carried = (m["inconsistency"] >= c.carried_inconsistency) | (m["smoothness"] < c.carried_smoothness)
    return F.when(n < c.type_min_points, "unknown").when(airborne, "airborne").when(rolling, "rolling").when(carried, "carried").otherwise("unknown")


def movement_confidence(kind: Column, m: dict[str, Column], n: Column, config: Config = Config()) -> Column:
    base = (
        F.when(kind == "airborne", (physics_score(m) + m["acceleration"] + m["smoothness"]) / 3)
        .when(kind == "rolling", F.least(F.lit(0.8), m["smoothness"] * (1 - m["vertical"])))
        .when(kind == "carried", F.least(F.lit(0.7), m["inconsistency"] * (1 - m["smoothness"])))
        .otherwise(F.lit(0.1))
    )
    return F.when(n < config.type_min_points, F.lit(0.0)).otherwise(N.clamp(base * F.least(F.lit(1.0), m["span"] / config.full_span_sec)))


def classify(df: DataFrame, points: str = "points", config: Config = Config()) -> DataFrame:
    """df with the measures, movement_type and type_confidence of its trajectories."""
    n = F.size(points)
    with_measures = df.withColumns(motion_details(F.col(points), config))
    m = {k: F.when(n < config.type_min_points, F.lit(v)).otherwise(F.col(k)) for k, v in (("inconsistency", 1.0), ("acceleration", 0.0), ("smoothness", 0.0), ("vertical", 0.0), ("span", 0.0))}
    return _typed(with_measures.withColumns(m), n, config)


def _typed(measured: DataFrame, n: Column, config: Config) -> DataFrame:
    m = {k: F.col(k) for k in ("inconsistency", "acceleration", "smoothness", "vertical", "span")}
    typed = measured.withColumn("movement_type", movement_type(m, n, config))
    return typed.withColumn("type_confidence", movement_confidence(F.col("movement_type"), m, n, config))


def validate(df: DataFrame, points: str = "points", loop_points: str = "loop_points", config: Config = Config()) -> DataFrame:
    """df with the measures of `classify` and is_valid, r2, gate_confidence and rejection_reason."""
    c, p = config, F.col(points)
    n = F.size(points)
    done = classify(df, points, config)
    first, last, prior = F.get(p, F.lit(0)), F.element_at(p, -1), F.get(p, n - 2)
    flat_time = last["t"] - first["t"] <= 0
    # Points that all have one time are taken as 30 a second.
    timed = F.when(flat_time, F.transform(p, lambda q, i: F.struct((i / 30.0).alias("t"), q["x"].alias("x"), q["y"].alias("y")))).otherwise(p)
    done = done.withColumn("timed", timed).withColumn("fit", N.quadratic_fit(F.col("timed")))
    before = F.slice("timed", 1, F.greatest(n - 1, F.lit(0)))
    done = done.withColumn("fit_before", F.when(n >= 5, N.quadratic_fit(before)))
    t_last = F.element_at("timed", -1)["t"] - F.get("timed", F.lit(0))["t"]
    ahead = F.col("fit_before")["a"] * t_last * t_last + F.col("fit_before")["b"] * t_last + F.col("fit_before")["c"]
    ys = F.transform("timed", lambda q: q["y"])
    v = N.steps(F.col("timed"), lambda a, b: (b["y"] - a["y"]) / F.greatest(F.lit(1e-3), b["t"] - a["t"]))
    done = done.withColumns({"span_y": F.array_max(ys) - F.array_min(ys), "velocities": v})
    turns = F.exists(F.sequence(F.lit(1), F.greatest(F.size("velocities") - 1, F.lit(1))), lambda i: F.coalesce(F.get("velocities", i) * F.get("velocities", i - 1) < 0, F.lit(False)))
    fastest = F.coalesce(F.array_max(F.transform("velocities", F.abs)), F.lit(0.0))
    moving = (fastest >= c.min_speed) | (turns & (F.col("span_y") >= c.min_span_y))
    xs = F.transform(loop_points, lambda q: q["x"])
    excursion = F.array_max(xs) - F.array_min(xs)
    loops = F.lit(c.reject_loops) & (F.size(loop_points) >= 4) & (excursion >= c.loop_min_excursion) & (F.abs(F.element_at(xs, -1) - F.get(xs, F.lit(0))) <= excursion * c.loop_return_ratio)
    done = done.withColumns({"jump": F.hypot(last["x"] - prior["x"], last["y"] - prior["y"]), "off_path": F.when(F.col("fit_before").isNotNull(), F.abs(ahead - last["y"])).otherwise(-1.0), "has_fit": F.col("fit").isNotNull(), "fit_a": F.col("fit")["a"], "fit_r2": F.col("fit")["r2"], "moving": moving, "loops": loops, "points_n": n})
    return _judged(done, config).drop("timed", "fit", "fit_before", "velocities")


def validate_windows(track_points: DataFrame, config: Config = Config()) -> DataFrame:
    """track_points(video_id, track_id, t, x, y, ...) as `validate` judges each one's `recent_points`, by arrays over sorted rows."""
    ticked = track_points.withColumn("tick", F.round(F.col("t") * 600).cast("long")).withColumns({c: F.col(c).cast("double") for c in ("t", "x", "y")})
    dealt = ticked.repartition("video_id", "track_id").sortWithinPartitions("video_id", "track_id", "t", "x", "y")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in ticked.schema if f.name != "tick"]
    measured = dealt.mapInArrow(lambda batches: windows.judged_by(batches, config), ", ".join([*columns, windows.TRAITS]))
    return _judged(_typed(measured, F.col("points_n"), config), config)


def _judged(done: DataFrame, config: Config) -> DataFrame:
    """df with the verdict from what `windows.TRAITS` names and its movement_type; the former go but for the measures.

    A trajectory is rejected by the first of: too few points, a jump at its end, an
    end far from where the points before it lead, no fit; then for all of the fit's
    failings together; then for its kind of movement; then for doubling back.
    """
    c, n = config, F.col("points_n")
    a, r2 = F.col("fit_a"), F.col("fit_r2")
    bent = a > 0 if c.y_down else a < 0
    low_fit = F.format_string("low R² (%.2f<%.2f)", r2, F.lit(max(0.0, c.min_r2)))
    failings = F.array_compact(
        F.array(
            F.when(~N.at_least(r2, max(0.0, c.min_r2)), low_fit),
            F.when(~bent, "curvature direction"),
            F.when(F.abs(a) < c.min_curvature, "curvature too small"),
            F.when(F.lit(c.use_gravity_band) & (F.abs(a) > c.max_curvature), "curvature > gravity band"),
            F.when(F.col("span_y") < c.min_span_y, "low vertical span"),
            F.when(~F.col("moving"), "no motion"),
        )
    )
    kind = F.col("movement_type")
    vetoes = F.lit(c.classify)
    # The reasons are fixed output values.
    reason = (
        F.when(n < c.min_points, "too few points in window")
        .when(F.col("jump") > c.max_jump, "position jump too big")
        .when(F.col("off_path") > c.max_offset_y, "off predicted path (ROI)")
        .when(~F.col("has_fit"), "no parabola fit")
        .when(F.size(failings) > 0, F.array_join(failings, ", "))
        .when(vetoes & (kind == "rolling"), "veto: rolling")
        .when(vetoes & F.lit(c.veto_carried) & (kind == "carried"), "veto: carried")
        .when(vetoes & (F.col("vertical") < c.rolling_vertical) & (F.col("acceleration") < c.min_gravity), "veto: flat + no gravity")
        .when(F.col("loops"), "doubling back (loop)")
    )
    judged = done.withColumn("rejection_reason", reason).withColumn("is_valid", F.col("rejection_reason").isNull())
    early = F.coalesce(F.col("rejection_reason").isin("too few points in window", "position jump too big", "off predicted path (ROI)", "no parabola fit"), F.lit(False))
    judged = judged.withColumn("r2", F.when(early, F.lit(0.0)).otherwise(r2))
    confidence = F.when(F.col("is_valid"), F.least(F.lit(1.0), F.col("r2"))).otherwise(F.lit(0.0))
    return judged.withColumn("gate_confidence", confidence).drop("points_n", "jump", "off_path", "has_fit", "fit_a", "fit_r2", "span_y", "moving", "loops")
