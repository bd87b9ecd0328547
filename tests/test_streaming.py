import pytest
from pyspark.sql import functions as F

from wingtally import streaming
from wingtally.operators import paths


def run(spark, tmp_path, batches, schema, made, name):
    """Rows of a stream that gets one file after the other."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    q = made(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        for i, b in enumerate(batches[1:], 1):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture
def at():
    from datetime import datetime, timedelta

    return lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)


def test_late_rows_are_dropped(spark, tmp_path, at):
    batches = [[("a", at(0), 1.0), ("a", at(30), 2.0)], [("a", at(200), 4.0)], [("a", at(10), 100.0), ("a", at(210), 8.0)], [("a", at(900), 0.0)], [("a", at(901), 0.0)]]
    got = run(spark, tmp_path, batches, "event_type string, ts timestamp, value double", lambda s: streaming.windowed(s, "1 minute", "1 minute"), "late")
    total = {r.start.minute: (r.n, r.total) for r in got}
    assert total[0] == (2, 3.0) and total[3] == (2, 12.0)


def test_pairs_of_two_clocks(spark, tmp_path, at):
    batches = [[(1, at(0), 1, "t"), (1, at(0.05), 2, "w"), (1, at(0.3), 3, "w")], [(1, at(0.35), 4, "t"), (2, at(0.3), 5, "t")]]

    def made(s):
        side = lambda k: s.where(F.col("side") == k).select("flight_id", "ts", "id")
        return streaming.paired(side("t"), side("w"))

    got = run(spark, tmp_path, batches, "flight_id long, ts timestamp, id long, side string", made, "pairs")
    assert sorted((r.id_t, r.id_w) for r in got) == [(1, 2), (4, 3)]


def test_repeats_and_changes(spark, tmp_path, at):
    rows = [[(1, 0, at(0), 5.0), (1, 1, at(1), 5.0), (1, 2, at(2), 6.0), (2, 0, at(0), 5.0)], [(1, 3, at(3), 6.0), (1, 4, at(4), 7.0), (1, 4, at(4), 7.0), (2, 1, at(5), None)]]
    schema = "flight_id long, frame long, ts timestamp, v double"
    got = run(spark, tmp_path / "a", rows, schema, lambda s: streaming.changes(s, "v"), "changes")
    assert sorted((r.flight_id, r.frame) for r in got) == [(1, 0), (1, 2), (1, 4), (2, 0), (2, 1)]
    got = run(spark, tmp_path / "b", rows, schema, lambda s: streaming.without_repeats(s, ["flight_id", "v"]), "repeats")
    assert sorted((r.flight_id, r.v or 0) for r in got) == [(1, 5.0), (1, 6.0), (1, 7.0), (2, 0), (2, 5.0)]


def test_streamed_resampling_equals_batch(spark, tmp_path):
    rows = [(f, 0.7 * i + 0.1 * f, float(i * i % 17)) for f in (1, 2) for i in range(40)]
    schema = "flight_id long, t double, alt double"
    parts = [[r for r in rows if a <= r[1] < a + 9] for a in (0, 9, 18, 27)]
    parts[2].append((1, 1.0, 999.0))  # too late
    got = run(spark, tmp_path, parts, schema, lambda s: streaming.resampled(s, 0.5, ["alt"]), "resampled")
    want = {(r.flight_id, r.tick): r.alt for r in paths.resample(spark.createDataFrame(rows, schema), 0.5, ["alt"]).collect()}
    assert {(r.flight_id, r.tick): pytest.approx(r.alt) for r in got} == want and len(got) == len(want)
