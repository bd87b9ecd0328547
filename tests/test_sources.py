import json
from pathlib import Path

import pytest

from wingtally import streaming
from wingtally.operators import tracking
from wingtally.sources import flights, tracks


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def text_of(spark, path):
    """The lines of a folder's files in order."""
    return [x for f in sorted(Path(path.removeprefix("file://")).glob("part-*")) for x in f.read_text().splitlines()]


def test_detection_files(spark, tmp_path):
    p = put(tmp_path / "a.txt", "# header\n\n0 1 2 3 4 0.5 0\n0 5 6 7 8\n3 1 1 2 2 0.9 1\nx y\n")
    d = tracks.read_detections(spark, p).orderBy("row_id")
    assert [(r.frame, r.confidence, r.class_id) for r in d.collect()] == [(0, 0.5, 0), (0, 1.0, 0), (3, 0.9, 1)]
    tracks.write_detections(d, f"file://{tmp_path}/out")
    assert text_of(spark, f"file://{tmp_path}/out")[:2] == ["# frame x1 y1 x2 y2 confidence class", "0 1.00 2.00 3.00 4.00 0.5000 0"]


def test_track_files(spark, tmp_path):
    p = put(tmp_path / "t.csv", "00000002,7,1,2,3,4,5,6,0.5,1,1\n00000001,-1,1,2,3,4,5,6,0.5,1,0\n")
    t = tracks.read_tracks(spark, p)
    assert {(r.frame, r.track_id, r.interpolated) for r in t.collect()} == {(2, 7, True), (1, None, False)}
    tracks.write_tracks(t, f"file://{tmp_path}/o")
    assert sorted(text_of(spark, f"file://{tmp_path}/o"))[1] == "00000002,7,1.000000,2.000000,3.000000,4.000000,5.000000,6.000000,0.500000,1,1"
    m = tracks.read_mot(spark, put(tmp_path / "m.txt", "1,3,183,903,35,40,1,2,0.5,x\n")).first()
    assert (m.x1, m.y1, m.x2, m.y2, m.extra) == (183, 903, 218, 943, ["0.5", "x"])
    strict = tracks.read_mot(spark, put(tmp_path / "s.txt", "1,-1,0,0,1,1,-1,-1,-1\n2,-1,0,0,1,1,0.5,1,1\n"), strict=True).collect()
    assert len({r.track_id for r in strict}) == 2 and strict[0].confidence is None
    y = tracks.read_yolo(spark, put(tmp_path / "frame_0012.txt", "1 0.5 0.5 0.2 0.4\n"), 100, 50).first()
    assert (y.frame, y.x1, y.y2, y.class_id) == (12, 40.0, 35.0, 1)


def test_poses_and_corrections(spark, tmp_path):
    p = put(tmp_path / "p.json", json.dumps({"images": [{"imagefile": "a", "location": [1, 2, 3], "rotation": [4, 5, 6], "fovy": [50]}]}))
    r = flights.read_poses(spark, p).first()
    assert (r.east, r.tilt, r.fovy) == (1, 4, 50)
    g = flights.read_poses(spark, put(tmp_path / "g.json", json.dumps({"images": [{"lat": 48.0, "lng": 14.0, "alt": 1.0, "pitch": 360.1, "roll": 0.0, "yaw": 10.0}]}))).first()
    assert g.tilt == pytest.approx(0.1) and g.lon == 14
    c = flights.read_corrections(spark, put(tmp_path / "c.json", json.dumps({"translation": {"x": 1, "y": 0, "z": 0}, "additional": [], "corrections": [{"start": 2, "end": 4, "rotation": {"x": 0.5, "y": 0, "z": 0}}]}))).orderBy("ord").collect()
    assert [(x.ord, x.start_frame, x.end_frame, x.tx, x.rx) for x in c] == [(-1, 0, None, 1, 0), (0, 2, 4, 1, 0.5)]


def test_logs(spark, tmp_path):
    t = flights.read_telemetry(spark, put(tmp_path / "l.csv", "time(millisecond),datetime(utc),height(feet),speed(mph),isVideo\n0,2024-01-01 10:00:00,328,10,1\n100,bad,,x,0\n")).orderBy("time").collect()
    assert t[0].height == pytest.approx(100) and t[0].speed == pytest.approx(16.093) and t[1].ts is None and t[1].speed is None
    s = flights.read_subtitles(spark, put(tmp_path / "s.srt", "1\n00:00:00,000 --> 00:00:00,033\n<font>FrameCnt: 1, DiffTime: 33ms\n2024-01-01 10:00:00.123\n[iso: 100] [shutter: 1/500] [latitude: 48.1] [longtitude: 14.2] [rel_alt: 1.5 abs_alt: 300.2]</font>\n\n2\n00:00:00,033 --> 00:00:00,066\nx\n")).orderBy("id").collect()
    assert (s[0].id, s[0].end_ms, s[0].diff_ms) == (0, 33, 33) and s[0].meta["longitude"] == "14.2" and s[0].meta["abs_alt"] == "300.2" and s[1].start_ms == 33


def test_survey_files(spark, tmp_path):
    route = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0)], "flight_id long, frame long, x double, y double")
    flights.write_route(route, f"file://{tmp_path}/r", 32633)
    back = flights.read_route(spark, f"file://{tmp_path}/r").orderBy("frame").collect()
    assert [(r.x, r.y) for r in back] == [(0, 1), (2, 3)]
    f = flights.read_polygons(spark, put(tmp_path / "f.txt", "3 1 1 2 3\n4 0\n5 2 1 2 3\n"))
    assert {r.frame: len(r.ring) for r in f.collect()} == {3: 1, 4: 0}
    n = flights.parsed_names(spark.createDataFrame([("x/146_DJI_20240102030405_0007_T.JPG",)], "file string")).first()
    assert (n.flight_name, n.frame_index, str(n.taken_at)) == ("146", 7, "2024-01-02 03:04:05")


def test_streamed_tracker_equals_batch(spark, tmp_path):
    sql = "select l_suppkey % 3 as flight_id, l_orderkey as frame, l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as row_id, l_partkey % 100 * 1.0D as x1, l_suppkey % 10 * 1.0D as y1, l_partkey % 100 + 20.0D as x2, l_suppkey % 10 + 20.0D as y2, 0L as class_id from {li}"
    d = spark.sql(sql, li=spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    low, high = d.where("frame < 700"), d.where("frame >= 700")
    low.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = streaming.tracked(stream, mode="greedy", least=0.1).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        high.coalesce(1).write.parquet(f"{tmp_path}/in/b")
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(r.row_id, r.track_id) for r in tracking.track_boxes(d, mode="greedy", least=0.1).collect()}
    assert {(r.row_id, r.track_id) for r in spark.table("tracked").collect()} == want


def test_windows_and_sessions(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert streaming.windowed(e).agg({"n": "sum"}).first()[0] == e.count()
    assert streaming.sessions(e).agg({"n": "sum"}).first()[0] == e.count()
