import random
from datetime import datetime, timedelta

import pytest

from wingtally.operators.tracking import track_boxes
from wingtally.streaming import ordered

SCHEMA = "flight_id long, ts timestamp, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, class_id int"


def scene(seed, flights=2, frames=24, animals=4):
    rng, start, out = random.Random(seed), datetime(2024, 1, 1), []
    for f in range(flights):
        at = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(animals)]
        for t in range(frames):
            for i, (x, y, vx, vy) in enumerate(at):
                if rng.random() < 0.85:
                    a, b = x + vx * t, y + vy * t
                    out.append((f, start + timedelta(milliseconds=100 * t), t, 1000 * t + i, a, b, a + 12, b + 12, i % 2))
    return out


def streamed(spark, tmp_path, batches, name, **how):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = ordered.tracked_in_order(source, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def end(at):
    return (99, datetime(2024, 1, 1) + timedelta(seconds=at), 0, 0, 0.0, 0.0, 1.0, 1.0, 0)


@pytest.mark.parametrize("mode", ["greedy", "hungarian_center"])
def test_shuffled_rows_get_the_ids_of_the_batch_tracker(spark, tmp_path, mode):
    rows = scene(7)
    want = sorted((r.flight_id, r.frame, r.row_id, r.track_id) for r in track_boxes(spark.createDataFrame(rows, SCHEMA), mode=mode).collect())
    random.Random(3).shuffle(rows)  # all are within the 2.4 seconds of the scene
    got = streamed(spark, tmp_path, [rows[0::3], rows[1::3], rows[2::3], [end(100)], [end(200)]], f"ordered_{mode}", late="5 seconds", mode=mode)
    assert [g for g in got if g[0] != 99] == want
    assert len({t for *_, t in want}) > 4


def test_rows_that_are_too_late_are_left_out(spark, tmp_path):
    rows = scene(5, flights=1)
    early, rest = [r for r in rows if r[2] < 6], [r for r in rows if r[2] >= 6]
    late = [(*early[0][:3], 99_999, *early[0][4:])]
    got = streamed(spark, tmp_path, [early, rest, [end(100)], [end(101)], [*late, (None, *early[0][1:])], [end(300)], [end(301)]], "ordered_late", late="1 second")
    want = sorted((r.flight_id, r.frame, r.row_id, r.track_id) for r in track_boxes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g for g in got if g[0] != 99] == want
