"""Streams of telemetry and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts and sums by window; rows later than `late` behind the newest are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row for each user's stretch of events without a pause of `gap`."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def paired(thermal: DataFrame, colour: DataFrame, within: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """Rows of two cameras of one flight whose clocks are at most `within` apart."""
    a = thermal.select("flight_id", F.col("ts").cast("timestamp").alias("ts_t"), F.col("id").alias("id_t")).withWatermark("ts_t", late)
    b = colour.select(F.col("flight_id").alias("flight_w"), F.col("ts").cast("timestamp").alias("ts_w"), F.col("id").alias("id_w")).withWatermark("ts_w", late)
    return a.join(b, F.expr(f"flight_id = flight_w and ts_w between ts_t - interval {within} and ts_t + interval {within}")).select("flight_id", "id_t", "id_w", "ts_t", "ts_w")


def tracked(detections: DataFrame, **how) -> DataFrame:
    """detections of a stream with track ids. A flight's tracker is its state; frames must come in order, each whole in one batch."""
    import pickle

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.assignment import Tracker

    def run(key, batches, state):
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(**how)
        pdf = pd.concat(list(batches)).sort_values(["frame", "row_id"]).reset_index(drop=True)
        for frame, rows in pdf.groupby("frame", sort=True):
            ids = tracker.frame(rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["class_id"].to_numpy(int))
            yield pd.DataFrame({"flight_id": key[0], "frame": frame, "row_id": rows["row_id"].to_numpy(), "track_id": ids})
        state.update((pickle.dumps(tracker),))

    return detections.groupBy("flight_id").applyInPandasWithState(run, "flight_id long, frame long, row_id long, track_id long", "tracker binary", "append", GroupStateTimeout.NoTimeout)


def without_repeats(rows: DataFrame, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """rows of a stream with time ts, of those that are equal in the columns only the first; repeats may come up to `late` after it."""
    e = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.dropDuplicatesWithinWatermark(columns)


def changes(rows: DataFrame, value: str) -> DataFrame:
    """rows (flight_id, frame, the value as a double) of a stream whose value differs from that of the flight's row before it; a flight's first row counts. Frames must come in order, each flight's last value is its state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("frame")
        before = pdf[value].shift()
        before.iloc[0] = last
        yield pdf[(pdf[value] != before) & ~(pdf[value].isna() & before.isna() & (pdf.index != pdf.index[0]))]
        state.update((float(pdf[value].iloc[-1]),))

    d = rows.select("flight_id", "frame", F.col(value).cast("double").alias(value))
    return d.groupBy("flight_id").applyInPandasWithState(run, d.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def resampled(telemetry: DataFrame, seconds: float, columns: list[str]) -> DataFrame:
    """Rows at every whole multiple of `seconds`, linear between a flight's neighbours (flight_id, t, columns). A flight's last row is its state; a row of a time before it is too late and left out."""
    import math

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        pdf = pd.concat(list(batches)).sort_values("t")
        if state.exists:
            old = pd.DataFrame([(key[0], *state.get)], columns=["flight_id", "t", *columns])
            pdf = pd.concat([old, pdf[pdf["t"] > old["t"].iloc[0]]])
        t = pdf["t"].to_numpy(float)
        first, last = math.ceil(t[0] / seconds), math.ceil(t[-1] / seconds)  # the last row's own tick belongs to what follows
        tick = np.arange(first, last)
        yield pd.DataFrame({"flight_id": key[0], "tick": tick, **{c: np.interp(tick * seconds, t, pdf[c].to_numpy(float)) for c in columns}})
        state.update((float(t[-1]), *(float(pdf[c].iloc[-1]) for c in columns)))

    d = telemetry.select("flight_id", F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in columns])
    kind = dict(telemetry.dtypes)["flight_id"]
    kept = ", ".join(f"{c} double" for c in ["t", *columns])
    return d.groupBy("flight_id").applyInPandasWithState(run, f"flight_id {kind}, tick long, " + ", ".join(f"{c} double" for c in columns), kept, "append", GroupStateTimeout.NoTimeout)
