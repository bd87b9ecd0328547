import io
import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingtally.functions import canvas
from wingtally.operators import clocks, terrain, tracks
from wingtally.sources import binary, exports, flights


def lines(path):
    return [x for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


@pytest.fixture(scope="module")
def boxes(spark):
    data = [(1, 7, 0, 0, 400000.0, 5300000.0, 400002.0, 5300002.0, 0.9, 1), (1, 7, 1, 1, 400001.0, 5300001.0, 400003.0, 5300003.0, 0.8, 1), (1, 9, 1, 2, 400010.0, 5300010.0, 400012.0, 5300012.0, 0.5, 0)]
    return spark.createDataFrame(data, "flight_id long, track_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id long")


def test_track_exports(spark, boxes, tmp_path):
    exports.write_track_states(boxes, tracks.class_vote(boxes), f"{tmp_path}/states")
    out = {d["id"]: d for d in map(json.loads, lines(tmp_path / "states"))}
    assert out[7]["class_id"] == 1 and [s["frame"] for s in out[7]["states"]] == [0, 1] and len(out[7]["states"][0]["pxlCoordinates"]) == 5
    exports.write_nested_tracks(boxes, f"{tmp_path}/nested")
    assert json.loads(lines(tmp_path / "nested")[0])["1"]["00"]["000001"] == [400001, 5300001, 400003, 5300003]
    exports.write_geojson_tracks(boxes, f"{tmp_path}/geo", 32633)
    g = json.loads(lines(tmp_path / "geo")[0])
    assert sorted(len(f["geometry"]["coordinates"]) for f in g["features"]) == [2, 2] and all(f["properties"]["color"].startswith("#") for f in g["features"])
    exports.write_movement(tracks.movement(boxes, 1.0), f"{tmp_path}/move")
    assert lines(tmp_path / "move")[0].startswith("flight_id,track_id,n")


def test_subtitles_round_trip(spark, tmp_path):
    rows = spark.sql("select id, id * 33 as start_ms, id * 33 + 33 as end_ms, timestamp '2024-01-01 10:00:00.5' as ts, 48.1D as latitude, 14.2D as longitude, 1.5D as rel_alt, 300.0D as abs_alt from range(3)")
    text = "\n".join(r.value for r in exports.subtitle_blocks(rows).orderBy("id").collect())
    (tmp_path / "a.srt").write_text(text)
    back = flights.read_subtitles(spark, f"file://{tmp_path}/a.srt").orderBy("id").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.diff_ms) for r in back] == [(i, i * 33, i * 33 + 33, 33) for i in range(3)] and back[0].meta["latitude"] == "48.100000"


def test_more_dialects(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0,5,9,1,0,2,8,1,0.5,1\n1 5 1 1 0 2 2 1 0.2 1\n")
    d = exports.read_geo_detections(spark, f"file://{tmp_path}/g.txt", 0.2).collect()
    assert len(d) == 1 and (d[0].x1, d[0].x2, d[0].frame) == (2, 9, 5)
    (tmp_path / "gt.txt").write_text("1,2,0,0,5,5,1,1,0.7\n1,3,0,0,5,5\n1,3,x,0,5,5\n")
    assert [r.confidence for r in exports.read_ground_truth(spark, f"file://{tmp_path}/gt.txt").orderBy("row_id").collect()] == [0.7, 1.0]
    (tmp_path / "t.json").write_text(json.dumps([{"id": 3, "speciesId": "Q1", "states": [{"frame": 4, "pxlCoordinates": [{"x": 1, "y": 2}, {"x": 5, "y": 0}]}]}]))
    r = exports.read_track_states(spark, f"file://{tmp_path}/t.json", {"Q1": 2}).first()
    assert (r.track_id, r.frame, r.x1, r.y1, r.x2, r.y2, r.class_id) == (3, 4, 1, 0, 5, 2, 2)


def test_binary_files(spark, tmp_path):
    np.savez(tmp_path / "a_id4.npz", frame=np.array([0, 1, np.nan], "f4"), poseX0=np.array([1, np.nan, 1], "f4"), poseY0=np.array([2, np.nan, 1], "f4"), poseX1=np.array([5, 7, 1], "f4"), poseY1=np.array([0, 8, 1], "f4"))
    got = {(r.track_id, r.frame, r.x1, r.y1, r.x2, r.y2) for r in binary.read_tracklets(spark, str(tmp_path)).collect()}
    assert got == {(4, 0, 1, 0, 5, 2), (4, 1, 7, 8, 7, 8)}
    pos = np.array([[0, 0, 1], [2, 3, 4]], "<f4").tobytes()
    head = json.dumps({"accessors": [{"bufferView": 0, "count": 2}], "bufferViews": [{"byteOffset": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}]}).encode()
    head += b" " * (-len(head) % 4)
    body = struct.pack("<II", len(head), 0x4E4F534A) + head + struct.pack("<II", len(pos), 0x004E4942) + pos
    (tmp_path / "m.glb").write_bytes(struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body)
    assert {(r.x, r.y, r.z) for r in binary.read_mesh(spark, str(tmp_path)).collect()} == {(0, 0, 1), (2, 3, 4)}
    (tmp_path / "p.jpg").write_bytes(b'x drone-dji:GpsLatitude="48.5" drone-dji:GpsLongitude="14.5" drone-dji:GimbalYawDegree="-10" drone-dji:GimbalRollDegree="178"')
    r = binary.read_drone_tags(spark, str(tmp_path)).first()
    assert (r.lat, r.yaw, r.roll, r.alt) == (48.5, 350, 0, None)
    packet = binary.klv([(2, b"\0" * 8)], b"\x06" * 16)
    assert len(packet) == 16 + 1 + 10 + 4 and int.from_bytes(packet[-2:], "big") == binary.checksum(packet[:-2])
    assert binary.ber_length(5) == b"\x05" and binary.ber_length(300) == b"\x82\x01\x2c"
    assert io.BytesIO(packet).read(2) == b"\x06\x06"


def test_canvas_and_lens(spark):
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(canvas.to_canvas(F.lit(5.0), F.lit(5.0), (0.0, 0.0, 10.0, 10.0)), "xy", strict=True)]).first()
    assert (r.x, r.y) == (400, 400)
    assert {t.tile for t in canvas.map_tiles(spark, 10.0, 10.0, 60_000.0, 20.0).collect()} == {"N0E0", "N0E50000"}
    m, lens = np.array([[500.0, 0, 320], [0, 500, 256], [0, 0, 1]]), np.array([0.1, -0.02, 0.001, 0.001, 0])
    u = np.array([[0.2, -0.1]])
    x, y = u[0]
    q = x * x + y * y
    k = 1 + q * (0.1 - 0.02 * q)
    seen = np.array([[x * k + 2e-3 * x * y + 1e-3 * (q + 2 * x * x), y * k + 1e-3 * (q + 2 * y * y) + 2e-3 * x * y]]) * 500 + m[:2, 2]
    assert np.allclose(canvas.undistorted(seen, m, lens), u * 500 + m[:2, 2], atol=1e-6)


def test_rays_meet_terrain():
    grid, cell = terrain.terrain(), 2.5
    rng = np.random.default_rng(1)
    h = grid.shape[0]

    def height(x, y):
        c, r = x / cell, (h - 1) - y / cell
        i, j = int(r), int(c)
        tx, ty = c - j, r - i
        a, b, d, e = grid[i, j], grid[i, j + 1], grid[i + 1, j], grid[i + 1, j + 1]
        return a + tx * (b - a) + ty * (d - a) if tx + ty <= 1 else e + (1 - tx) * (d - e) + (1 - ty) * (b - e)

    for _ in range(100):
        aim = rng.uniform(40, 160, 2)
        target = np.array([*aim, height(*aim)])
        origin = target + np.array([*rng.uniform(-30, 30, 2), 60.0])
        hit = terrain.first_hit(grid, cell, origin, (target - origin) / 60)
        assert hit is not None and np.abs(hit - target).max() < 1e-3
    assert terrain.first_hit(grid, cell, np.array([50.0, 50.0, 60.0]), np.array([0.0, 0.0, 1.0])) is None


def test_clock_offset(spark):
    t = spark.range(60).selectExpr("1L as flight_id", "cast(id as double) as t", "48 + sin(id / 5.0) / 1000 as lat", "14 + cos(id / 7.0) / 1000 as lon")
    got = clocks.clock_offset(t.where("t between 10 and 50").withColumn("t", F.col("t") - 0.3), t).first()
    assert got.offset == pytest.approx(0.3, abs=0.05)
