"""Stateful streams against their batch twins, with rows out of order, late rows and silent keys."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import detections as D
from trackloom.operators import intervals, stateful
from trackloom.streaming import live, twins

FRAMES = "video_id long, t double, has_ball boolean, is_projectile boolean, ball_y double"
BOXES = "video_id string, frame_idx long, t double, det_idx int, x double, y double, w double, h double, kept_idx int"


def batches_of(rows, seed, spread):
    """Rows in batches, each row up to `spread` seconds after others that are later."""
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + rnd.random() * spread)
    return [[r[1] for r in late[k : k + 60]] for k in range(0, len(late), 60)]


@pytest.fixture
def stream(spark, tmp_path):
    """stream(batches, schema, plan): all rows that come out, and the query's progress."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    live.use_rocksdb(spark)

    def run(batches, schema, plan):
        source = str(tmp_path / "in")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{source}/{k:04d}")
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(source)
        query = plan(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None and not query.isActive
        return spark.read.parquet(str(tmp_path / "out")).toPandas(), query.recentProgress

    yield run
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_decider_in_any_order(spark, stream):
    rnd, rows = random.Random(2), []
    for v in (1, 2, 3):
        rich = True
        for k in range(150):
            rich ^= rnd.random() < 0.05
            ball = rnd.random() < (0.9 if rich else 0.1)
            rows.append((k * 0.1, (v, k * 0.1, ball, ball and rnd.random() < 0.8, 0.5)))
    whole = [r for _, r in rows]
    # video 9 only moves the watermark on; video 8 is on when it falls silent
    silent = [(8, k * 0.05, True, True, 0.5) for k in range(30)]
    batches = [*batches_of(rows, 5, 1.5), [(9, 40.0, False, False, None)], [(1, 1.0, True, True, 0.5)], [(9, 80.0, False, False, None)]]
    batches[0] += silent
    got, progress = stream(batches, FRAMES, lambda s: live.decide(s, late="2 seconds", silent=10.0))
    own = got[got.video_id < 8]
    want = stateful.decide(spark.createDataFrame(whole, FRAMES)).toPandas()
    own, want = own.assign(t=own.t.round(6)), want.assign(t=want.t.round(6))  # as JSON numbers the last bit may differ
    key = ["video_id", "t"]
    on_time = own[own.t < 20]
    merged = on_time.merge(want, on=key, suffixes=("", "_want"))
    assert len(merged) == len(want) == len(on_time) and (merged.is_active == merged.is_active_want).all()
    closed = got[(got.video_id == 8) & (got.t > 10)]
    assert closed.t.round(2).tolist() == [11.45] and not closed.is_active.any()
    assert sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p["stateOperators"]) == 1
    # of all keys only the one that moves the watermark is left, and nothing of what fell silent
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def boxes(seed, n=150):
    rnd, rows = random.Random(seed), []
    for v in ("a", "b"):
        for k in range(n):
            t = k / 30
            own = [(0.1 + 0.1 * t, 0.3 + 0.05 * t), (0.7, 0.2)] + ([(rnd.random(), rnd.random())] if rnd.random() < 0.5 else [])
            rows += [(t, (v, k, t, i, x, y, 0.03, 0.03, i)) for i, (x, y) in enumerate(own)]
    return rows


def test_tracker_in_any_order(spark, stream):
    rows = boxes(3)
    batches = [*batches_of(rows, 1, 0.4), [("z", 0, 60.0, 0, 0.5, 0.5, 0.1, 0.1, 0)]]
    got, _ = stream(batches, BOXES, lambda s: live.track(s, late="1 second", silent=5.0))
    want = stateful.track(spark.createDataFrame([r for _, r in rows], BOXES)).toPandas()
    key = ["video_id", "frame_idx", "det_idx"]
    a, b = (x[x.video_id != "z"].sort_values(key).reset_index(drop=True)[want.columns] for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_static_cells_in_any_order(spark, stream):
    rows = boxes(4)
    batches = [*batches_of(rows, 1, 0.4), [("z", 0, 200.0, 0, 0.5, 0.5, 0.1, 0.1, 0)]]
    got, _ = stream(batches, BOXES, lambda s: live.suppress_static(s, late="1 second"))
    want = D.suppress_static(spark.createDataFrame([r for _, r in rows], BOXES)).toPandas()
    pick = lambda x: sorted(zip(x.video_id, x.frame_idx, x.det_idx, strict=True))
    assert pick(got[got.video_id != "z"]) == pick(want) and len(want) < len(rows)
    with pytest.raises(ValueError):
        live.suppress_static(spark.createDataFrame([], BOXES), silent=5.0)



def test_counters_after_replay_and_compaction(spark, tmp_path):
    changes, table = str(tmp_path / "changes"), str(tmp_path / "table")

    def put(k, rows):
        spark.createDataFrame(rows, "key string, delta long").coalesce(1).write.mode("append").json(changes)
        read = spark.readStream.schema("key string, delta long").json(changes)
        twins.into_table(read, table, str(tmp_path / f"checkpoint{k}"), "key", "n").awaitTermination(120)

    def counts():
        return {r.key: r.n for r in twins.counter_table(spark, table, "key", "n", clamp=False).collect()}

    put(0, [("a", 1), ("b", 2)])
    put(0, [("a", 1), ("c", -1)])
    put(0, [("b", 5)])
    want = {"a": 2, "b": 7, "c": -1}
    assert counts() == want
    assert twins.compact(spark, table, "key", "n", upto=1) == 1 and counts() == want
    # batch 0 is written again, as after a failure between its write and its commit
    spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long").write.mode("overwrite").parquet(f"{table}/batch=0")
    assert counts() == want
    # a compaction that ended before it was finished
    spark.createDataFrame([("a", 99)], "key string, n long").write.parquet(f"{table}/base=2")
    (tmp_path / "table" / "base=2" / "_SUCCESS").unlink()
    assert counts() == want
    twins.sweep(spark, table)
    assert counts() == want and not (tmp_path / "table" / "batch=0").exists() and (tmp_path / "table" / "batch=2").exists()
    assert twins.compact(spark, table, "key", "n") == 2 and counts() == want
    put(0, [("d", 3)])
    assert counts() == want | {"d": 3}


def test_streams_joined_in_time(spark, tmp_path):
    rnd = random.Random(9)
    at = lambda k: datetime(2024, 1, 1) + timedelta(seconds=k)
    probes = [(rnd.choice("xy"), at(k * 7 + rnd.randrange(5)), k) for k in range(40)]
    rows = [(rnd.choice("xy"), at(rnd.randrange(300)), k) for k in range(80)]
    for name, schema, data in (("p", "key string, ts timestamp, probe long", probes), ("r", "key string, ts timestamp, row long", rows)):
        ends = [("z", at(100_000 + k), -1 - k) for k in range(2)]
        for k, part in enumerate((data[::2], data[1::2], ends[:1], ends[1:])):
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / name / f"{k}"))
    for nearest in (True, False):
        read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / name))
        found = twins.nearest_within(read("p", "key string, ts timestamp, probe long"), read("r", "key string, ts timestamp, row long"), "key", "row", "5 seconds", "probe", "10 minutes", nearest)
        out = str(tmp_path / f"out{nearest}")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        got = {r.probe: r.row for r in spark.read.parquet(out).collect() if r.probe >= 0}
        p, r = (spark.createDataFrame(d, f"key string, ts timestamp, {n} long").withColumn("t", F.unix_timestamp("ts").cast("double")) for d, n in ((probes, "probe"), (rows, "row")))
        batch = intervals.nearest_within(p, r, "key", "t", "row", 5.0, "probe") if nearest else intervals.first_within(p, r, "key", "t", "row", 5.000001, "probe")
        assert got == {x.probe: x.r_row for x in batch.collect()} and got
