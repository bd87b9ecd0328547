"""A tracker over a stream whose frames come in any order: they wait, by event time, until the watermark has passed them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.assignment import Tracker

_BOX = ["x1", "y1", "x2", "y2"]
#: The store of states that maps and timers need, for spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """State of a flight: its tracker, the time it has come to, and the boxes that wait, by the time of their frame. A timer for each such time lets go of what the watermark has passed."""

    def __init__(self, how: dict):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "tracker binary, time long")
        self.waiting = handle.getMapState("waiting", "time long", "boxes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.tracker.get()[1] if self.tracker.exists() else None
        for pdf in rows:
            for time, boxes in pdf.groupby("time", sort=False):
                time = int(time)
                if done is not None and time <= done:
                    continue
                at = (time,)
                held = [pickle.loads(self.waiting.getValue(at)[0])] if self.waiting.containsKey(at) else []
                if not held:
                    self.handle.registerTimer(time)
                self.waiting.updateValue(at, (pickle.dumps(pd.concat([*held, boxes[["frame", "row_id", *_BOX, "class_id"]]])),))
        yield pd.DataFrame({"flight_id": [], "frame": [], "row_id": [], "track_id": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(t for (t,) in self.waiting.keys() if t <= until)
        if not due:
            return
        tracker = pickle.loads(self.tracker.get()[0]) if self.tracker.exists() else Tracker(**self.how)
        for t in due:
            pdf = pickle.loads(self.waiting.getValue((t,))[0]).sort_values(["frame", "row_id"])
            for frame, rows in pdf.groupby("frame", sort=True):
                ids = tracker.frame(rows[_BOX].to_numpy(float), rows["class_id"].to_numpy(int))
                yield pd.DataFrame({"flight_id": key[0], "frame": frame, "row_id": rows["row_id"].to_numpy(), "track_id": ids})
            self.waiting.removeKey((t,))
        self.tracker.update((pickle.dumps(tracker), due[-1]))

    def close(self) -> None:
        pass


def tracked_in_order(detections: DataFrame, late: str = "10 seconds", **how) -> DataFrame:
    """detections (flight_id, ts, frame, row_id, box, class_id) of a stream with the track ids that `track_boxes` gives the whole table, if no row is more than `late` behind the newest.

    Rows may come in any order, a frame in several batches; frames are taken in order of ts, which has milliseconds, then of frame.
    Rows that are later are left out, as are rows without a flight, ts, frame or row_id. Waiting boxes are those of the last `late` of event time only.
    The session must keep its states in STORE."""
    d = detections.withColumn("ts", F.col("ts").cast("timestamp")).where("flight_id is not null and ts is not null and frame is not null and row_id is not null").withWatermark("ts", late)
    d = d.select(F.col("flight_id").cast("long"), "ts", F.unix_millis("ts").alias("time"), F.col("frame").cast("long"), F.col("row_id").cast("long"), *_BOX, "class_id")
    return d.groupBy("flight_id").transformWithStateInPandas(_InOrder(how), "flight_id long, frame long, row_id long, track_id long", "append", "EventTime")
