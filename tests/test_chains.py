import json
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wingtally.functions import canvas, geodesy, optics
from wingtally.operators import assignment, clocks, estimators, georeference, rasters, terrain, tracking, tracks
from wingtally.sources import binary, flights, formats, pictures
from wingtally.sources import rasters as files


def lzw(data):
    """Codes of 9 to 12 bits as TIFF packs them."""
    codes, width, out, table, word = [(256, 9)], 9, "", {bytes([i]): i for i in range(256)}, b""
    for b in data:
        new = word + bytes([b])
        if new in table:
            word = new
            continue
        codes.append((table[word], width))
        table[new] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            codes.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([b])
    codes += [(table[word], width), (257, width)]
    out = "".join(f"{c:0{w}b}" for c, w in codes)
    out += "0" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


def test_lzw():
    rng = random.Random(1)
    for data in (b"abababababab" * 50, bytes(rng.randrange(256) for _ in range(9000)), b"\0" * 70_000, b"x"):
        assert files.unlzw(lzw(data)) == data


def tiled(values, bounds, packing):
    """A big-endian file of 16 x 16 tiles."""
    h, w = values.shape
    tiles = []
    for r in range(0, h, 16):
        for c in range(0, w, 16):
            t = np.zeros((16, 16), ">u2")
            part = values[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            if packing == 5:
                t = np.diff(t.astype(np.int64), axis=1, prepend=0).astype(">u2")
            tiles.append(lzw(t.tobytes()) if packing == 5 else t.tobytes())
    at, offsets = 8, []
    for t in tiles:
        offsets.append(at)
        at += len(t)
    sx, sy = (bounds[2] - bounds[0]) / w, (bounds[3] - bounds[1]) / h
    fields = [(256, "H", (w,)), (257, "H", (h,)), (258, "H", (16,)), (259, "H", (packing,)), (277, "H", (1,)), (317, "H", (2 if packing == 5 else 1,)), (322, "H", (16,)), (323, "H", (16,)), (324, "I", offsets), (325, "I", [len(t) for t in tiles]), (339, "H", (1,)), (33550, "d", (sx, sy, 0)), (33922, "d", (0, 0, 0, bounds[0], bounds[3], 0)), (34735, "H", (1, 1, 0, 1, 3072, 0, 1, 32633)), (42113, "s", b"7\0")]
    head, more, after = b"", b"", at + 6 + 12 * len(fields)
    for tag, c, v in fields:
        data = v if c == "s" else struct.pack(f">{len(v)}{c}", *v)
        code = {"H": 3, "I": 4, "d": 12, "s": 2}[c]
        head += struct.pack(">HHI", tag, code, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", after + len(more)))
        more += data if len(data) > 4 else b""
    return struct.pack(">2sHI", b"MM", 42, at) + b"".join(tiles) + struct.pack(">H", len(fields)) + head + struct.pack(">I", 0) + more


@pytest.mark.parametrize("packing", [1, 5])
def test_tiled_rasters(spark, tmp_path, packing):
    v = np.arange(20 * 37).reshape(20, 37) % 500
    (tmp_path / "a.tif").write_bytes(tiled(v, (100.0, 200.0, 137.0, 240.0), packing))
    i = files.read_raster_info(spark, f"file://{tmp_path}").first()
    assert (i.width, i.height, i.bands, i.min_x, i.min_y, i.max_x, i.max_y, i.cell_w, i.cell_h, i.epsg, i.nodata) == (37, 20, 1, 100, 200, 137, 240, 1, 2, 32633, 7)
    got = {(r.row, r.col): r.value for r in files.read_raster(spark, f"file://{tmp_path}").collect()}
    assert got == {(r, c): None if v[r, c] == 7 else float(v[r, c]) for r in range(20) for c in range(37)}
    z = files.read_elevation(spark, f"file://{tmp_path}")
    assert {(r.row, r.col) for r in z.where("z is null").collect()} == {(r, c) for r in range(20) for c in range(37) if v[r, c] in (0, 7)}


def test_raster_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(f, r, c, float(r * 10 + c) / 4) for f in ("a.tif", "b.tif") for r in range(150) for c in range(9) if (r, c) != (2, 3)], "file string, row long, col long, value double")
    bounds = (400000.0, 5300000.0, 400018.0, 5300300.0)
    files.write_files(files.raster_files(cells, bounds, 9, 150, 32633), f"file://{tmp_path}/out")
    back = files.read_raster(spark, f"file://{tmp_path}/out").withColumn("file", F.substring_index("file", "/", -1))
    assert sorted(back.where("value is not null").select("file", "row", "col", "value").collect()) == sorted(cells.collect())
    assert back.where("value is null").select("row", "col").distinct().collect() == [(2, 3)]
    info = files.read_raster_info(spark, f"file://{tmp_path}/out")
    assert {(i.min_x, i.min_y, i.max_x, i.max_y, i.epsg, i.nodata) for i in info.collect()} == {(*bounds, 32633, -9999.0)}
    placed = info.withColumn("file", F.substring_index("file", "/", -1)).withColumn("min_x", F.col("min_x") + (F.col("file") == "b.tif").cast("int") * 4).withColumn("max_x", F.col("max_x") + (F.col("file") == "b.tif").cast("int") * 4)
    out, grid = files.merged(back, placed, 2.0)
    assert (grid["width"], grid["height"]) == (11, 150) and out.where("row = 2 and col = 3").first().value == (20 + 1) / 4 and out.count() == 11 * 150
    assert files.clipped(out, grid, (400001.0, 5300299.0, 400003.0, 5300301.0)).count() == 2
    assert files.thinned(out, 5).agg(F.max("row"), F.max("col")).first() == (29, 2)


def test_sidecars():
    assert files.world_file((100.0, 0.0, 110.0, 20.0), 10, 10) == "1.0000000000\n0.0\n0.0\n-2.0000000000\n100.5000000000\n19.0000000000\n"
    assert [files.world_file_name(n) for n in ("a.tif", "b.JPG", "c.bin")] == ["a.tfw", "b.jgw", "c.bin.wld"]
    assert "UTM zone 33N" in files.projection_text(32633) and '"central_meridian",15]' in files.projection_text(32633)


MATRIX, LENS = np.array([[1000.0, 0, 640], [0, 1005.0, 360], [0, 0, 1]]), np.array([-0.25, 0.08, 1e-3, -5e-4, 0.01])


def distorted(p, m, lens):
    k1, k2, p1, p2, k3, k4, k5, k6 = (*lens, *[0] * 8)[:8]
    x, y = (p[:, 0] - m[0, 2]) / m[0, 0], (p[:, 1] - m[1, 2]) / m[1, 1]
    r = x * x + y * y
    radial = (1 + k1 * r + k2 * r**2 + k3 * r**3) / (1 + k4 * r + k5 * r**2 + k6 * r**3)
    return np.stack([m[0, 0] * (x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x)) + m[0, 2], m[1, 1] * (y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y) + m[1, 2]], 1)


@pytest.mark.parametrize("lens", [LENS, np.r_[LENS, 0.02, -0.01, 0.001]])
def test_undistortion(spark, lens):
    p = np.random.RandomState(0).uniform((50, 50), (1230, 670), (40, 2))
    assert canvas.undistorted(distorted(p, MATRIX, lens), MATRIX, lens) == pytest.approx(p, abs=1e-3)
    rows = spark.createDataFrame(pd.DataFrame(distorted(p, MATRIX, lens), columns=["x", "y"]))
    assert canvas.undistort_points(rows, MATRIX, lens).toPandas().to_numpy() == pytest.approx(p, abs=1e-3)


def test_new_matrix():
    same = canvas.new_matrix(MATRIX, np.zeros(5), (1281, 721), (1281, 721), 0.0, one_focus=False)
    assert same == pytest.approx(MATRIX, abs=1e-6)
    size = (1280, 720)
    for alpha in (0.0, 1.0):
        m = canvas.new_matrix(MATRIX, LENS, size, size, alpha, one_focus=False)
        edge = np.array([[x, y] for x in (0, 639.5, 1279) for y in (0, 359.5, 719)])
        u = canvas.undistorted(edge, MATRIX, LENS, m)
        out = u[[i for i in range(9) if i != 4]]
        away = np.maximum(np.abs(out[:, 0] - 639.5) / 639.5, np.abs(out[:, 1] - 359.5) / 359.5)
        assert (away > 0.999).all() if alpha == 0 else (away < 1.001).all()
    m = canvas.new_matrix(MATRIX, LENS, size, (1024, 1024), 0.5)
    assert m[0, 0] == m[1, 1] and (m[0, 2], m[1, 2]) == (511.5, 511.5) and canvas.fovy_of(m, 1024) == pytest.approx(2 * math.degrees(math.atan(512 / m[1, 1])))


def test_survey_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"mtx": [[1, 0, 2], [0, 3, 4], [0, 0, 1]], "dist": [[0.1, -0.2, 0, 0, 0.3]]}))
    (tmp_path / "d.json").write_text(json.dumps({"mtx": [[1, 0, 2], [0, 3, 4], [0, 0, 1]]}))
    c = {r.file[-6:]: r for r in flights.read_calibration(spark, f"file://{tmp_path}/[cd].json").collect()}
    assert c["c.json"].dist == [0.1, -0.2, 0, 0, 0.3] and c["d.json"].dist == [0.0] * 5 and c["c.json"].mtx[1] == [0, 3, 4]
    (tmp_path / "p.json").write_text(json.dumps({"perpendiculas": [{"frame": 3, "detection_center": [1, 2, 3], "foot_point": [4, 5], "distance_m": 6.5, "class_id": None}]}))
    (tmp_path / "q.json").write_text(json.dumps({"tracks": [{"last_frame": 8, "detection_center": [1, 2, 3], "foot_point": [4, 5], "distance_m": 7.5, "class_id": 2}, {"detection_center": [0, 0, 0], "foot_point": [0, 0], "distance_m": 0}]}))
    r = {(x.frame, x.x, x.foot_y, x.distance, x.class_id) for x in flights.read_perpendicular(spark, f"file://{tmp_path}/[pq].json").collect()}
    assert r == {(3, 1.0, 5.0, 6.5, 0), (8, 1.0, 5.0, 7.5, 2), (-1, 0.0, 0.0, 0.0, 0)}
    log = spark.sql("select 'a' as file, id as row_id, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 9 - id) as ts from range(5) union all select 'b', 0, timestamp '2024-01-01 00:00:00'")
    (e,) = flights.start_and_end(log).collect()
    assert (e.file, e.start.second, e.end.second) == ("a", 9, 5)
    p = spark.createDataFrame([("/x/y/z/f.txt",), ("/x/f.txt",), ("/q/f.txt",)], "p string")
    assert [r[0] for r in p.select(flights.relative_folder("/x/", F.col("p"))).collect()] == ["y/z", "", None]
    flights.write_points(spark.createDataFrame([(1, 1, 2.0, 3.0, "n"), (1, 0, 0.0, 1.0, "m")], "flight_id long, frame long, x double, y double, name string"), f"file://{tmp_path}/pts", 32633)
    g = json.loads(spark.read.text(f"file://{tmp_path}/pts").first()[0])
    assert [(f["geometry"]["coordinates"], f["properties"]["name"]) for f in g["features"]] == [([0.0, 1.0], "m"), ([2.0, 3.0], "n")]


def test_thermal_pictures(spark, tmp_path):
    t = np.random.RandomState(0).uniform(5, 40, (6, 8))
    raw = np.round((t + 273.15) * 64).astype("<u2").tobytes()
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (6).to_bytes(2, "big") + (8).to_bytes(2, "big") + b"\x01\x11\x00\xff\xd9"
    (tmp_path / "a.jpg").write_bytes(head + raw + b"\0" * 512)
    (tmp_path / "b.jpg").write_bytes(head + bytes(2000))
    got = binary.read_thermal(spark, f"file://{tmp_path}").toPandas()
    assert len(got) == 48 and got.sort_values(["row", "col"])["celsius"].to_numpy() == pytest.approx(t.ravel(), abs=0.01)


def test_rays_on_a_heightfield(spark):
    rng = np.random.RandomState(2)
    grid = terrain.terrain((21, 31), 6.0, 3)
    heights = spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(21) for c in range(31)], "row long, col long, z double")
    rows = [(i, float(rng.uniform(0, 512)), float(rng.uniform(0, 512)), float(rng.uniform(-5, 80)), float(rng.uniform(-5, 55)), float(rng.uniform(15, 40)), float(rng.uniform(0, 85)), float(rng.uniform(0, 360))) for i in range(150)]
    d = spark.createDataFrame(rows, "row_id long, px double, py double, east double, north double, up double, tilt double, heading double")
    want = {r.row_id: (r.gx, r.gy, r.gz) for r in terrain.pixels_to_terrain(d, grid, 2.5, 50.0, 512.0, 512.0).collect()}
    out = terrain.pixels_to_heights(d, heights, 21, 2.5, 50.0, 512.0, 512.0)
    got = {r.row_id: (r.gx, r.gy, r.gz) for r in out.collect()}
    hits = [i for i in want if want[i][0] is not None]
    assert len(got) == 150 and 40 < len(hits) < 150 and {i for i in got if got[i][0] is not None} == set(hits)
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in hits)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("+- BroadcastNestedLoopJoin") <= 1  # with the one row of the field's extent
    with pytest.raises(ValueError):
        terrain.pixels_to_terrain(d, np.zeros((3000, 3000)), 1.0, 50.0, 512.0, 512.0)


def test_exact_unions(spark):
    rng = np.random.RandomState(5)
    rings = []
    for i in range(25):
        a = np.sort(rng.uniform(0, 6.28, 5))
        c, r = rng.uniform(0, 10, 2), rng.uniform(0.5, 3)
        rings.append(("many", [{"x": float(c[0] + r * math.cos(t)), "y": float(c[1] + r * math.sin(t))} for t in a]))
    box = lambda x, y, w: [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + w}, {"x": x, "y": y + w}]
    rings += [("two", box(0.0, 0.0, 10.0)), ("two", box(5.0, 0.0, 10.0)), ("two", box(5.0, 0.0, 10.0)), ("star", [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 5.0, "y": 2.0}, {"x": 5.0, "y": 10.0}])]
    d = spark.createDataFrame(rings, "k string, ring array<struct<x:double,y:double>>")
    got = {r.k: r.area for r in rasters.union_area_exact(d, "k", 1.7).collect()}
    assert got["two"] == pytest.approx(150.0) and got["star"] == pytest.approx(30.0)
    fine = {r.k: r.area for r in rasters.union_area(d, "k", 0.02).collect()}
    assert got["many"] == pytest.approx(fine["many"], rel=2e-3)


def test_poses_of_photos(spark):
    log = spark.createDataFrame([(1, i, float(10 * i), 48.0 + i * 1e-4, 14.0, 400.0 + i, -80.0, 90.0 + i, 1.0) for i in range(6)], "flight_id long, log_id long, t double, lat double, lon double, alt double, gimbal_pitch double, gimbal_heading double, compass_heading double")
    photos = spark.createDataFrame([(1, 1, 9.0), (1, 2, 12.0), (1, 3, 99.0)], "flight_id long, photo_id long, t double")
    origin = {"lat": 48.0, "lon": 14.0, "alt": 400.0}
    one = {r.photo_id: r for r in georeference.photo_poses(photos, log, origin, 32633, 50.0, 4.0).collect()}
    assert set(one) == {1, 2} and one[1].up == one[2].up == 1.0 and one[1].tilt == 10.0 and one[1].heading == 91.0 and one[1].fovy == 50.0
    assert one[1].north == pytest.approx(11.12, abs=0.02)
    unique = {r.photo_id: r.up for r in georeference.photo_poses(photos, log, origin, 32633, 50.0, 9.0, "unique").collect()}
    assert unique == {1: 1.0, 2: 2.0}
    ordered = {r.photo_id: r.up for r in georeference.photo_poses(photos, log, origin, 32633, 50.0, 0.0, "ordered").collect()}
    assert ordered == {1: 0.0, 2: 1.0, 3: 2.0}
    turned = georeference.photo_poses(photos, log, origin, 32633, 50.0, 4.0, grid_north=True, gimbal=False).first()
    assert 0.5 < abs(turned.heading - 1.0) < 1.0


def test_polygons_and_pictures(spark):
    poses = spark.createDataFrame([(1, 0, 10.0, 20.0, 30.0, 20.0, 40.0)], "flight_id long, frame long, east double, north double, up double, tilt double, heading double")
    ring = [{"x": 100.4, "y": 200.6}, {"x": 300.0, "y": 50.0}]
    p = spark.createDataFrame([(1, 0, 5, ring), (1, 9, 6, ring)], "flight_id long, frame long, row_id long, ring array<struct<x:double,y:double>>")
    pose = poses.first()

    def cast(x, y):
        d = [v for v in spark.range(1).select(*optics.pixel_to_ground(F.lit(float(x)), F.lit(float(y)), tuple(map(F.lit, (10.0, 20.0, 30.0))), F.lit(20.0), F.lit(40.0), 50.0, 512.0, 512.0)).first()]
        return np.array(d)

    got = {r.row_id: r.ground_ring for r in georeference.polygons_on_ground(p, poses, 50.0, 512.0, 512.0).collect()}
    want = np.mean([cast(100 + i, 200 + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))], axis=0)
    assert [got[5][0].x, got[5][0].y] == pytest.approx(want) and got[6] == [None, None]
    one = georeference.polygons_on_ground(p, poses, 50.0, 512.0, 512.0, boxed=False).where("row_id = 5").first().ground_ring[0]
    assert [one.x, one.y] == pytest.approx(cast(100.4, 200.6))
    whole = georeference.pixels_on_ground_whole(spark.createDataFrame([(1, 0, 100.9, 200.9)], "flight_id long, frame long, px double, py double"), poses, 50.0, 512.0, 512.0).first()
    assert [whole.gx, whole.gy] == pytest.approx(cast(100, 200))
    cells = spark.createDataFrame([(i, *map(float, cast(x, y)), 0.0) for i, (x, y) in enumerate([(64, 128), (256, 256), (500, 20)])] + [(9, 900.0, 900.0, 0.0)], "cell long, x double, y double, z double")
    places = georeference.picture_places(cells, poses, 50.0, 512.0, 512.0, 60.0)
    uv = {r.cell: (r.u, r.v) for r in places.collect()}
    assert uv[0] == pytest.approx((64 / 512, 128 / 512)) and uv[1] == pytest.approx((0.5, 0.5)) and 9 not in uv
    pictures = spark.createDataFrame([(1, 0, r, c, float(10 * r + c) if (r, c) != (0, 3) else None) for r in range(4) for c in range(4)], "flight_id long, frame long, row long, col long, value double")
    value = {r.cell: r.value for r in georeference.picture_values(places, pictures, 4, 4).collect()}
    assert value[0] == pytest.approx(10 * 0.25 * 3 + 0.125 * 3) and value[1] == pytest.approx(16.5) and value[2] is None
    assert pose.up == 30


def test_the_chain_of_boxes(spark):
    poses = spark.createDataFrame([(1, f, 10.0 * f, 5.0, 20.0, 0.0, 0.0) for f in range(3)], "flight_id long, frame long, east double, north double, up double, tilt double, heading double")
    ranges = spark.createDataFrame([(1, 0, 1, 1, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 0, None, 0.0, 0.0, 5.0, 0.0, 0.0, math.radians(90))], "flight_id long, ord int, start_frame long, end_frame long, tx double, ty double, tz double, rx double, ry double, rz double")
    boxes = spark.createDataFrame([(1, f, f, 200.0, 200.0, 312.0, 256.0) for f in range(3)], "flight_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double")
    flat = {r.frame: r for r in georeference.georeferenced(boxes, poses, ranges, 50.0, 512.0, 512.0).collect()}
    k = math.tan(math.radians(25))
    assert flat[1].min_x == pytest.approx(12 - 56 / 256 * k * 20) and flat[1].max_y == pytest.approx(5 + 56 / 256 * k * 20) and flat[1].min_y == pytest.approx(5)
    assert flat[0].max_x - flat[0].min_x == pytest.approx(56 / 256 * k * 25)
    heights = spark.createDataFrame([(r, c, 4.0) for r in range(30) for c in range(60)], "row long, col long, z double")
    hill = {r.frame: r for r in georeference.georeferenced(boxes, poses, ranges, 50.0, 512.0, 512.0, heights, 30, 1.0).collect()}
    assert hill[1].min_z == hill[1].max_z == 4.0 and hill[1].max_x == pytest.approx(12 + 56 / 256 * k * 16)
    own = georeference.without_corrections(ranges, "flight_id").first()
    assert not own.identity and georeference.without_corrections(ranges.where("ord > 5").unionByName(spark.createDataFrame([(2, 0, 0, None, *[0.0] * 6)], ranges.schema)), "flight_id").first().identity


def test_model_hook(spark):
    def model(batches):
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["path"], "x1": 1.0, "confidence": [0.2 + 0.1 * i for i in range(len(pdf))]})

    pictures = spark.createDataFrame([(f"p{i}",) for i in range(6)], "path string").coalesce(1)
    assert georeference.detected(pictures, model, "file string, x1 double, confidence double", 0.45).count() == 3


def test_boxes_one_by_one(spark):
    rows = [(1, 0, 0, 0.0), (1, 1, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 3, 50.0), (1, 9, 4, 2.0), (1, 9, 5, 51.0)]
    d = spark.createDataFrame([(a, f, i, x, 0.0, x + 10, 10.0) for a, f, i, x in rows], "flight_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double")
    ids = lambda **k: [r.track_id for r in tracking.track_each(d, **k).orderBy("row_id").collect()]
    assert ids() == [1, 1, 1, 2, 3, 4] and ids(offset=8) == [1, 1, 1, 2, 1, 2] and ids(centres=True, reach=1.5) == [1, 1, 1, 2, 3, 4]
    t = assignment.Nearest(centres=True)
    for f, x in ((0, 0.0), (0, 20.0), (1, 10.0)):
        t.take(f, np.array([x, 0, x + 4, 4]))
    assert t.frames.tolist() == [0, 0, 1]


def test_groups_of_candidates(spark):
    edges = [(1, 11), (1, 12), (2, 12), (3, 13), (4, 14), (5, 14), (5, 15), (6, 15), (7, 15)]
    c = spark.createDataFrame([(a, b, 9, float(a + b)) for a, b in edges], "track_t long, track_w long, shared long, median_dist double")
    got = {r.track_t: r.group for r in tracking.candidate_groups(c).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4}


def test_population(spark):
    rng = np.random.RandomState(1)
    d = spark.createDataFrame([("a", int(rng.poisson(3)), float(rng.uniform(5, 20))) for _ in range(40)], "stratum string, count long, area_ha double")
    r = estimators.population(d, study_ha=250.0, n_boot=99).first()
    naive = estimators.naive(d).first().density
    assert r.naive == naive and r.naive_animals == pytest.approx(naive * 2.5) and r.bootstrap_animals_low < r.naive_animals < r.bootstrap_animals_high and r.zinb == pytest.approx(naive, rel=0.2) and r.n_transects == 40


def test_times_without_pairs(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([float(i), i + 0.25, float(i - i % 3)]), float(i * i)) for k in (1, 2) for i in range(40)] + [(3, 0, 5.0, 1.0)]
    d = spark.createDataFrame(rows, "flight_id long, id long, t double, v double").withColumn("frame", F.col("id"))
    asks = spark.createDataFrame([(k, float(x) / 4) for k in (1, 2, 3, 4) for x in range(-20, 200, 7)], "flight_id long, at double")
    near = {(r.flight_id, r.at): r.id for r in clocks.nearest_row(d, asks, 3.0).collect()}
    spans = {(r.flight_id, r.range_id): (r.start_frame, r.end_frame) for r in clocks.index_ranges(d, asks.selectExpr("flight_id", "at as range_id", "at as low", "at + 9 as high"), width=2.0).collect()}
    for r in asks.collect():
        own = [x for x in rows if x[0] == r.flight_id]
        best = min(((abs(x[2] - r.at), x[2], x[1]) for x in own if abs(x[2] - r.at) <= 3), default=None)
        assert near.get((r.flight_id, r.at)) == (best and best[2])
        inside = [x[1] for x in own if r.at <= x[2] <= r.at + 9]
        assert spans.get((r.flight_id, r.at)) == ((min(inside), max(inside)) if inside else None)
    for f in (clocks.nearest_row(d, asks, 3.0), clocks.at_times(d, asks, "v")):
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.replace("BroadcastHashJoin", "") or "NestedLoop" not in plan


def test_partners_by_cells(spark):
    rng = random.Random(8)
    data = [(f, i + 100 * f, x := rng.uniform(0, 60), y := rng.uniform(0, 40), x + rng.uniform(0.5, 25), y + rng.uniform(0.5, 9)) for f in range(4) for i in range(60)]
    d = spark.createDataFrame(data, "frame long, row_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.a_id: (r.b_id, round(float(r.iou), 4)) for r in tracks.best_partner(d, 0.05, cell=7.0).collect()}

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        i = max(w, 0) * max(h, 0)
        return float(np.float32(i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)))

    for a in data:
        best = min(((-round(v, 5), b[1], round(v, 4)) for b in data if b[0] == a[0] and b[1] != a[1] and (v := iou(a, b)) >= np.float32(0.05)), default=None)
        assert got.get(a[1]) == (best and best[1:])


def test_picture_tags(spark, tmp_path):
    plain = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02rest\xff\xd9"
    rows = [("a.jpg", plain, 48.12345678, -14.5, 312.25, "M", None, "2024-05-01 10:11:12", "note é"), ("b.jpg", plain, -1.5, 0.0, 0.0, None, "Cam", None, None)]
    d = spark.createDataFrame(rows, "file string, content binary, lat double, lon double, alt double, make string, model string, ts string, comment string").withColumn("ts", F.to_timestamp("ts"))
    files.write_files(pictures.tagged(d), f"file://{tmp_path}/p")
    (tmp_path / "p" / "c.jpg").write_bytes(plain)
    got = {r.file[-5:]: r for r in pictures.read_picture_tags(spark, f"file://{tmp_path}/p").collect()}
    a, b, c = got["a.jpg"], got["b.jpg"], got["c.jpg"]
    assert (a.lat, a.lon, a.alt) == pytest.approx((48.12345678, -14.5, 312.25), abs=1e-7) and (a.make, a.model, str(a.ts), a.comment) == ("M", "", "2024-05-01 10:11:12", "note é")
    assert (b.lat, b.lon, b.alt, b.model, b.ts) == (-1.5, 0.0, 0.0, "Cam", None) and (c.lat, c.alt, c.make) == (None, None, None)
    again = pictures.with_tags((tmp_path / "p" / "a.jpg").read_bytes(), 1.0, 2.0, 3.0)
    assert again.count(b"Exif") == 1 and again.endswith(b"rest\xff\xd9") and pictures.picture_tags(again)["lat"] == 1.0
    extra = b"http://ns.adobe.com/xap/1.0/\0<x/>"
    plain = b"\xff\xd8\xff\xe1" + (len(extra) + 2).to_bytes(2, "big") + extra + b"\xff\xd9"
    deep = pictures.with_tags(pictures.with_tags(plain, 1.0, 2.0, 3.0), -1.0, 2.0, -12.25)
    assert pictures.picture_tags(deep)["alt"] == -12.25 and deep.count(b"Exif") == 1 and extra in deep
    assert pictures.picture_tags(b"\xff\xd8Exif\0\0II\x2a\0\xff\0\0\0")["lat"] is None


def test_mesh_files(spark, tmp_path):
    h = spark.createDataFrame([(r, c, float(r * c)) for r in range(4) for c in range(5)], "row long, col long, z double")
    v, f = rasters.heightfield_mesh(h, 5, 4, 2.0)
    flat_v, flat_f = pictures.flat_mesh(spark, "flat.glb", 10.0, 20.0, 5.0, 8.0)
    v, f = (t.withColumn("file", F.lit("hill.glb")) for t in (v, f))
    files.write_files(pictures.mesh_files(v.unionByName(flat_v), f.unionByName(flat_f)), f"file://{tmp_path}/m")
    back = binary.read_mesh(spark, f"file://{tmp_path}/m").withColumn("file", F.substring_index("file", "/", -1))
    assert {(r.x, r.y, r.z) for r in back.where("file = 'flat.glb'").collect()} == {(6.0, 16.0, 5.0), (14.0, 16.0, 5.0), (14.0, 24.0, 5.0), (6.0, 24.0, 5.0)}
    faces = pictures.read_faces(spark, f"file://{tmp_path}/m").withColumn("file", F.substring_index("file", "/", -1))
    assert sorted(faces.where("file = 'hill.glb'").select("a", "b", "c").collect()) == sorted(f.select("a", "b", "c").collect()) and back.where("file = 'hill.glb'").count() == 20


def test_logs_of_subtitles(spark, tmp_path):
    (tmp_path / "s.srt").write_text("1\n00:00:00,000 --> 00:00:00,033\nDiffTime: 33ms\n2024-01-01 10:00:00.123\n[latitude: 48.1] [longitude: 14.2] [rel_alt: 1.5 abs_alt: 300.2] [gb_yaw: 12.5 gb_pitch: -80 gb_roll: 0]\n")
    r = georeference.log_of_subtitles(flights.read_subtitles(spark, f"file://{tmp_path}/s.srt")).first()
    assert (r.id, r.time, r.latitude, r.altitude, r.altitude_above_sea_level, r.gimbal_pitch, r.gimbal_heading, r.pitch, r.is_video) == (0, 33, 48.1, 1.5, 300.2, -80.0, 12.5, None, 1)
    log = spark.createDataFrame([(1, 2.0, 0.0)], "flight_id long, height_above_takeoff double, altitude double")
    ref = spark.createDataFrame([(1, 500.0, 40.0)], "flight_id long, altitude double, height_above_takeoff double")
    assert georeference.heights_by_reference(log, ref).first().altitude == 462.0


def test_formats_by_name(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# x\n3,7,0,0,0,1,1,1,0.5,2\n1 7 0 0 0 1 1 1 0.5 2 0.25\n2,8,a,0,0,1,1,1,0.5,2\n2,8,1\n1,-1,0,0,0,1,1,1,0.5,0\n")
    t = formats.read(spark, "geo_tracks", f"file://{tmp_path}/t.txt")
    assert sorted((r.frame, r.track_id, r.visibility) for r in t.collect()) == [(1, -1, 1.0), (1, 7, 0.25), (3, 7, 1.0)]
    from wingtally.sources import tracks as track_files

    assert [(r.frame, r.source_id) for r in track_files.sorted_tracks(t.where("track_id > 0")).collect()] == [(1, 1), (3, 0)]
    with pytest.raises(Exception, match="without a track"):
        track_files.sorted_tracks(t).collect()
    d = spark.createDataFrame([("f", 0, 1, 1.0, 2.0, 3.0, 4.0, 0.5, 0)], "file string, row_id long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id long")
    formats.write(d, "detections", f"file://{tmp_path}/d")
    assert formats.read(spark, "detections", f"file://{tmp_path}/d").first().x2 == 3.0
    formats.register("ones", lambda spark, path, n=1: spark.range(n))
    assert formats.read(spark, "ones", "", n=3).count() == 3 and "ones" in formats.names()
    for call in (lambda: formats.read(spark, "none", ""), lambda: formats.write(d, "ones", "")):
        with pytest.raises(ValueError):
            call()


def test_drones(spark):
    d = spark.createDataFrame([("DJI_M30T",), ("m3te",), ("M30",), ("Phantom",), (None,)], "n string").select(canvas.drone_of(F.col("n")).alias("d"))
    assert [r.d for r in d.collect()] == ["M30T", "M3T", "M30T", None, None]
    s = {(r.drone, r.camera): (r.width, r.height) for r in canvas.known_sensors(spark).collect()}
    assert s["M30T", "thermal"] == (1280, 1024) and s["M300", "zoom"] == (None, None) and ("M2EA", "zoom") not in s
    assert d.select(canvas.product_name(F.col("d"))).first()[0] == "DJI_M30T"


def test_origins(spark):
    o = geodesy.origin(48.0, 14.0, 300.0, 32633)
    assert (o["east"], o["north"]) == pytest.approx((425405, 5316784), abs=2)
    there = spark.range(1).select(*geodesy.to_utm(F.lit(48.0), F.lit(14.0), 32633)).first()
    assert tuple(there) == pytest.approx((o["east"], o["north"]), abs=1e-6)
    g = spark.createDataFrame([(48.001, 14.0, 310.0, -100.0, 0.0, 350.0)], "lat double, lon double, alt double, pitch double, roll double, yaw double")
    r = georeference.local_poses(g, o).first()
    assert (r.up, r.tilt, r.heading) == (10.0, 350.0, 350.0) and r.north == pytest.approx(111.15, abs=0.05)
    assert 349 < georeference.local_poses(g, o, True).first().heading % 360 < 351 and georeference.local_poses(g, o, True).first().heading != 350.0


def test_outlines_of_masks(spark):
    cells = lambda f, m: [(f, int(r), int(c), 255.0 if m[r, c] else 9.0) for r in range(m.shape[0]) for c in range(m.shape[1])]
    box = np.zeros((40, 60), bool)
    box[5:20, 10:50] = True
    box[30:34, 3:9] = True
    box[8:12, 20:30] = False  # a hole has no say
    y, x = np.mgrid[:80, :80]
    disc = (x - 40) ** 2 + (y - 38) ** 2 <= 30**2
    u = np.ones((20, 30), bool)
    u[:15, 10:20] = False
    dot = np.zeros((5, 5), bool)
    dot[2, 3] = True
    d = spark.createDataFrame(cells("box", box) + cells("disc", disc) + cells("u", u) + cells("none", np.zeros((3, 3), bool)) + cells("dot", dot), "file string, row long, col long, value double")
    got = {r.file: [(p.x, p.y) for p in r.ring] for r in georeference.mask_outlines(d).collect()}
    assert set(got) == {"box", "disc", "u", "dot"} and sorted(got["box"]) == [(10, 5), (10, 19), (49, 5), (49, 19)] and got["dot"] == [(3, 2)]
    assert len(got["u"]) == 8 and {(9.0, 0.0), (20.0, 0.0), (29.0, 19.0)} <= set(got["u"])
    p = np.array(got["disc"])
    area = abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2
    assert 6 < len(p) < 40 and area == pytest.approx(math.pi * 900, rel=0.06)
    whole = {r.file: len(r.ring) for r in georeference.mask_outlines(d, tolerance=0.0).collect()}
    assert whole["box"] == 2 * (40 + 15) - 4
    assert [(p.x, p.y) for p in spark.range(1).select(georeference.frame_ring(640, 512).alias("r")).first().r][2:5] == [(640, 0), (640, 256), (640, 512)]
