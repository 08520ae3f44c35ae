"""Stateful operators on streams that come out of order: rows wait for the watermark, and silent keys are forgotten.

A row of a key is held in a list until the watermark has passed it; then a timer of event
time fires, and the rows that are due are stepped in their order, so any shuffling within the
watermark gives what the batch operator gives.  Rows that come later than the watermark
are dropped by Spark, and counted as `numRowsDroppedByWatermark` in the query's progress.  A
key without a row for `silent` seconds of event time is closed, and its state goes.

State lies in RocksDB: call `use_rocksdb` before a query starts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.config import Config
from ..operators.decider import Memory, columns_of, decided
from ..operators.detections import StaticCell, cell_of
from ..operators.kernels import Tracker
from ..operators.stateful import TRACK_POINTS, followed

Step = Callable[[object, pd.DataFrame], tuple[pd.DataFrame, object]]
#: Added to times from the start of a video, so that frame 0 is not at the watermark that every query begins with.
ORIGIN_MS = 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Steps the rows of a key in order as the watermark passes them.

    step(state, rows) gives rows to emit and the new state, of plain values, which is
    kept as JSON; close(state, key, t), if given, the rows that a silent key leaves.
    """

    def __init__(self, columns: StructType, order: list[str], step: Step, silent: float, close: Callable | None = None):
        self.columns, self.order, self.step, self.silent_ms, self.close_rows = columns, order, step, int(silent * 1000), close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.memory = handle.getValueState("memory", "state string, last_ms long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last, timer = self.memory.get() if self.memory.exists() else (None, -1, -1)
        first = None
        for part in rows:
            came = (part["ts"].astype("datetime64[ms]").astype("int64")).tolist()
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in row) for row in part[self.columns.names].astype(object).itertuples(index=False)])
            last, first = max(last, *came), min(came) if first is None else min(first, *came)
        if first is not None:
            wake = min(first + 1, last + self.silent_ms)
            if timer < 0 or wake < timer:
                self._wake_at(timer, wake)
                timer = wake
            self.memory.update((state, last, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state, last, timer = self.memory.get()
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.columns.names)
        came = rows["ts"].astype("datetime64[ms]").astype("int64") if len(rows) else pd.Series([], dtype="int64")
        # a row of the watermark's own millisecond may have others after it
        due = rows[came < now]
        kept = json.loads(state) if state else None
        if len(due):
            out, kept = self.step(kept, due.sort_values(self.order, kind="stable"))
            state = json.dumps(kept)
            yield out
        later = rows[came >= now]
        if not len(later) and last + self.silent_ms < now:
            self.waiting.clear()
            self.memory.clear()
            closing = self.close_rows(kept, key, (last + self.silent_ms - ORIGIN_MS) / 1000) if self.close_rows else None
            if closing is not None:
                yield closing
            return
        if len(later):
            self.waiting.put([tuple(r) for r in later.astype(object).itertuples(index=False)])
        else:
            self.waiting.clear()
        wake = min(int(came[came >= now].min()) + 1 if len(later) else last + self.silent_ms + 1, last + self.silent_ms + 1)
        self.handle.registerTimer(wake)
        self.memory.update((state, last, wake))

    def _wake_at(self, before: int, wake: int) -> None:
        if before >= 0:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(wake)

    def close(self) -> None:
        pass


def _stepped(rows: DataFrame, keys: list[str], order: list[str], step: Step, out: str, late: str, silent: float, close: Callable | None = None) -> DataFrame:
    """rows(t in seconds, ...) with their watermark, through `InOrder` by keys."""
    timed = rows.withColumn("ts", F.timestamp_millis(F.floor(F.col("t") * 1000) + ORIGIN_MS)).withWatermark("ts", late)
    processor = InOrder(timed.schema, order, step, silent, close)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def decide(frames: DataFrame, config: Config = Config(), late: str = "2 seconds", silent: float = 10.0) -> DataFrame:
    """video_id, t and is_active of a stream frames(video_id, t, has_ball, is_projectile, ball_y).

    Where play is on as a video falls silent, a row `silent` seconds after its last frame says that it has ended.
    """

    def step(state, rows):
        memory, since = state or (asdict(Memory()), None)
        active, memory, since = decided(Memory(**memory), since, columns_of(rows), config)
        return pd.DataFrame({"video_id": rows.video_id.to_numpy(), "t": rows.t.to_numpy(), "is_active": active}), (asdict(memory), since)

    def close(state, key, t):
        return pd.DataFrame({"video_id": [key[0]], "t": [t], "is_active": [False]}) if state and state[1] is not None else None

    rows = frames.select("video_id", F.col("t").cast("double"), "has_ball", "is_projectile", F.col("ball_y").cast("double"))
    kind = rows.schema["video_id"].dataType.simpleString()
    return _stepped(rows, ["video_id"], ["t"], step, f"video_id {kind}, t double, is_active boolean", late, silent, close)


def track(detections: DataFrame, config: Config = Config(), late: str = "2 seconds", silent: float = 10.0) -> DataFrame:
    """Points of tracks of a stream of detections, as `stateful.track` makes them; ids begin again after a silence."""

    def step(state, rows):
        tracker = Tracker.resumed(config, state)
        return followed(tracker, rows), tracker.snapshot()

    rows = detections.select(F.col("video_id").cast("string"), "frame_idx", F.col("t").cast("double"), "det_idx", "x", "y", "w", "h")
    return _stepped(rows, ["video_id"], ["t", "frame_idx", "det_idx"], step, TRACK_POINTS, late, silent)


def suppress_static(detections: DataFrame, config: Config = Config(), order: str = "kept_idx", late: str = "2 seconds", silent: float = 60.0) -> DataFrame:
    """A stream of detections without hits of cells that stay where they are; state is per cell of a video.

    A cell that is not hit for `silent` seconds, which should be more than it is muted for, starts anew.
    """
    if silent <= config.static_mute_sec:
        raise ValueError("a muted cell must not be forgotten before it may speak again")

    def step(state, rows):
        cell = StaticCell.resumed(config, state)
        kept = [cell.keeps(t, x + w / 2, y + h / 2) for t, x, y, w, h in zip(rows.t, rows.x, rows.y, rows.w, rows.h, strict=True)]
        return rows[kept][names], cell.snapshot()

    names = detections.columns
    celled = detections.withColumn("cell", cell_of(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, config))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in detections.schema)
    return _stepped(celled, ["video_id", "cell"], ["t", order], step, out, late, silent)
