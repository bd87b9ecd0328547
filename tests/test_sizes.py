"""Steps whose cost must follow the input: how often plans work values out, and how much trackers look at."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from wingtally.functions import boxes, optics
from wingtally.operators import assignment, clocks, estimators, georeference, joins, motion, rasters, terrain, tracking, tracks


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue().lower()


def test_rings_are_worked_out_once(spark):
    t = spark.range(10).select(F.col("id").cast("double").alias("alt"), (F.col("id") * 36.0).alias("heading"))
    ring = optics.flat_footprint(F.lit(0.0), F.lit(0.0), F.col("alt"), F.col("heading"), 50.0)
    once = plan(t.select(ring.alias("r"))).count("cos(")
    assert plan(t.select(boxes.ring_area(ring).alias("a"))).count("cos(") == once
    assert t.select(F.min(boxes.ring_area(F.slice(ring, 1, 2)))).first()[0] == 0.0


def test_contours_are_turned_once(spark):
    ring = F.array(*[F.struct(F.sin(F.col("id") + x).alias("x"), F.sin(F.col("id") + y).alias("y")) for x, y in ((5, 1), (1, 1), (1, 4), (5, 4))])
    t = spark.range(3)
    once = plan(t.select(ring.alias("r"))).count("sin(")
    assert plan(t.select(georeference.clockwise(ring).alias("r"))).count("sin(") == once
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    flat = F.array(point(0.0, 0.0), point(2.0, 2.0), point(1.0, 1.0))
    assert [tuple(p) for p in t.select(georeference.clockwise(flat)).first()[0]] == [(0, 0), (2, 2), (1, 1)]


def test_ends_of_short_tracks_are_not_unfolded(spark):
    rows = [(1, 1, 8, 1), (1, 2, 10, 2), (1, 2, 11, 3), (1, 2, 12, 4), (1, 3, 16, 5), (1, 4, 15, 6), (1, 5, 9, 7), (1, 5, 10, 8)]
    t = spark.createDataFrame(rows, "flight_id long, track_id long, frame long, row_id long").selectExpr("*", "0.0D as x1", "0.0D as y1", "1.0D as x2", "1.0D as y2")
    got = tracks.fragments(t, 3, 2, 0.5, 0.5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1), (1, 4, 2, 2)]
    assert "sequence(" not in plan(got)


def test_trackers_look_at_boxes_nearby(monkeypatch):
    looks = []
    one = assignment.overlap
    monkeypatch.setattr(assignment, "overlap", lambda a, b: looks.append(1) or one(a, b))
    boxes_at = lambda x: np.stack([x, 0 * x, x + 10, 0 * x + 8], 1)
    t, far = assignment.Tracker(mode="greedy"), np.arange(500) * 100.0
    assert t.frame(boxes_at(far), np.zeros(500, int)).tolist() == list(range(1, 501)) and not looks
    assert t.frame(boxes_at(far[::-1] + 1), np.zeros(500, int)).tolist() == list(range(500, 0, -1)) and len(looks) == 500
    n = assignment.Nearest(least=0.5)
    looks.clear()
    for f in range(300):  # tracks that have closed are not looked at
        assert n.take(10 * f, np.array([0.0, 0.0, 4.0, 4.0])) == f + 1
        n.forget(10 * f)
    assert not looks and len(n.at) == 1


def test_flights_are_read_in_batches(spark):
    d = spark.range(400).selectExpr("id % 3 as flight_id", "id div 10 as frame", "id as row_id", "id * 7 % 40 * 1.0D as x1", "0.0D as y1", "id * 7 % 40 + 9.0D as x2", "8.0D as y2", "id % 2 as class_id")
    for track in (tracking.track_boxes, tracking.track_each):
        assert "flatmapgroups" not in plan(track(d, least=0.1))
        whole = {(r.flight_id, r.row_id): r.track_id for r in track(d, least=0.1).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert {(r.flight_id, r.row_id): r.track_id for r in track(d, least=0.1).coalesce(1).collect()} == whole and len(whole) == 400
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_points_of_short_routes_are_not_unfolded(spark, monkeypatch):
    route = spark.range(120).selectExpr("id % 2 as flight_id", "id as frame", "id * 37 % 101 * 1.0D as x", "id * 53 % 89 * 1.0D as y")
    points = spark.range(90).selectExpr("id % 3 as flight_id", "id as point_id", "id * 29 % 97 * 1.0D as px", "id * 31 % 83 * 1.0D as py")
    segs = joins.segments(route)
    find = lambda: sorted(map(tuple, joins.nearest_on_route(points, segs).where("seg is not null").collect()))
    assert joins.near_segments(points, segs, "flight_id", "px", "py", "point_id").count() == 60 * 59  # all of the flight, once
    near = find()
    monkeypatch.setattr(joins, "SHORT", 0)
    assert find() == near and len(near) == 60


def test_rays_over_small_fields_are_not_dealt_by_cell(spark, monkeypatch):
    heights = spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", "cast(id % 3 as double) as z")
    rays = spark.range(60).selectExpr("id as row_id", "cast(id * 37 % 512 as double) as px", "cast(id * 53 % 512 as double) as py", "id % 23 - 1.3D as east", "id % 17 + 0.7D as north", "9.0D as up", "cast(id % 60 as double) as tilt", "id * 40 % 360 + 0.1D as heading")
    found = lambda: terrain.pixels_to_heights(rays, heights, 20, 1.0, 50.0, 512.0, 512.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once, rows = plan(found()), sorted(map(tuple, found().collect()), key=lambda r: r[0])
        monkeypatch.setattr(terrain, "SMALL", 0)
        dealt, same = plan(found()), sorted(map(tuple, found().collect()), key=lambda r: r[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert once.count("hashpartitioning(_r#") == 1 and dealt.count("hashpartitioning(_r#") == 2  # the field's own
    assert rows == same and 0 < sum(r[-1] is None for r in rows) < len(rows) == 60


def test_clocks_are_searched_on_plain_numbers(spark):
    looked = []
    for start in (-5.0, 0.0, 5.0):
        for f in (lambda p: abs(p - 0.3) + np.sin(9 * p), lambda p: round(p, 2) ** 2, lambda p: float("nan") if p < 1 else (p - 2) ** 2, lambda p: 7.0):
            place, value = clocks.line_search(lambda p, f=f: looked.append(p) or f(p), start, 1.0)
            old, least = estimators.simplex(lambda p, f=f: f(float(p[0])), [start], 1.0)
            assert (place, value) == (float(old[0]), least) or np.isnan(value)
            assert len(looked) == len(set(looked))
            looked.clear()
    rows = [(k, float(i), 48 + (i * 7 + (k or 5)) % 31 / 1e4, 14 + (i * 5) % 23 / 1e4) for k in (1, 2, None) for i in range(40)] + [(3, 0.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "flight_id long, t double, lat double, lon double")
    out = clocks.clock_offset(t.where("flight_id is null or flight_id < 3").withColumn("t", F.col("t") - 0.3), t)
    assert "flatmapgroups" not in plan(out)
    got = {r.flight_id: r.offset for r in out.collect()}
    assert set(got) == {1, 2, 3, None} and got.pop(3) is None and all(abs(x - 0.3) < 1e-6 for x in got.values())


def test_motion_reads_flights_in_batches(spark):
    rows = [(k, f, 100 * f + i, 20.0 * i + f % 9, 3.0 * k, 20.0 * i + f % 9 + 9, 3.0 * k + 8, 0.9 if f % 5 else 0.3) for k in (1, 2) for f in range(60) for i in range(3) if f % 7 or not i]
    rows += [(1, f, 7000 + f, None, 0.0, 1.0, 1.0, 0.9) for f in range(55, 70)]
    d = spark.createDataFrame(rows, "flight_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    found = lambda: sorted(map(tuple, motion.track_by_motion(d).collect()), key=lambda r: r[:3])
    assert "flatmapgroups" not in plan(motion.track_by_motion(d))
    whole, before = found(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert found() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) == len(rows) and {r[3] for r in whole} >= {1, 2, 3, None}


def test_equal_rings_are_laid_out_once(spark, monkeypatch):
    d = spark.range(600).selectExpr("id % 2 as k", "cast(id % 5 as double) as x", "cast(id % 3 as double) as y")
    at = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    rings = d.select("k", F.array(at(0.0, 0.0), at(2.0, 0.0), at(2.0, 1.0), at(0.0, 1.0)).alias("ring"))
    spans, seen = rasters._row_spans, []
    monkeypatch.setattr(rasters, "_row_spans", lambda r, *how: seen.append(r.count()) or spans(r, *how))
    cover = {(r.row, r.col): r.n for r in rasters.coverage(rings).collect()}
    assert seen == [15] and sum(cover.values()) == 1200 and cover[0, 0] == 40 and cover[0, 1] == 80
    assert {r.k: r.area for r in rasters.union_area(rings, "k", 0.5).collect()} == {0: 18.0, 1: 18.0} and seen == [15, 30]
    out = rasters.union_area_exact(rings, "k")
    assert {r.k: round(r.area, 9) for r in out.collect()} == {0: 18.0, 1: 18.0} and "keys=[_key#" in plan(out).split("mapinpandas")[-1]


def test_rounds_of_refinement_deal_pairs_once(spark, monkeypatch):
    rows = [(f, t, 7.0 * t + f % 5, 11.0 * (t % 3)) for f in range(30) for t in range(4)]
    a = spark.createDataFrame(rows, "frame long, track_id long, cx double, cy double").withColumn("confidence", F.lit(0.9))
    b = a.withColumn("cx", F.col("cx") * 1.01 + 2).withColumn("cy", F.col("cy") + 1)
    pairs = spark.range(30).select(F.col("id").alias("frame_a"), F.col("id").alias("frame_b"))
    fit, seen = tracks.fit_affine, []
    monkeypatch.setattr(tracks, "fit_affine", lambda chosen: seen.append(plan(chosen)) or fit(chosen))
    best, error = tracking.refined_affine(a, b, pairs, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))
    assert len(seen) > 1 and all(p.count("exchange") == 1 for p in seen)
    assert error < 1e-6 and abs(best[0] - 1.01) < 1e-6 and abs(best[4] - 2) < 1e-6
    got = {(r.track_t, r.track_w): (r.shared, r.median_dist) for r in tracks.candidates(a, b, pairs, best).collect()}
    assert got[1, 1][0] == 30 and got[1, 1][1] < 1e-6 and len(got) == 16
    assert "percentile(_d" in plan(tracks.candidates(a, b, pairs))


def test_boxes_of_tracks_are_dealt_once_for_their_ends(spark):
    rows = [(1, t, t * 10 + f, t * 100 + f, 0.0, 0.0, 4.0, 4.0) for t in range(20) for f in range(3 if t % 2 else 9)] + [(1, 0, 0, 9000, 1.0, 1.0, 5.0, 5.0), (1, 21, None, 9001, 0.0, 0.0, 4.0, 4.0)]
    d = spark.createDataFrame(rows, "flight_id long, track_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double")
    out = tracks.fragments(d, 4, 3, 0.1, 2.0)
    moves = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(flight_id" in line]
    assert moves and not any("track_id" in line and "frame" in line for line in moves)  # frames of a track stay where its boxes are
    assert sorted(tuple(r) for r in out.collect()) == [(1, t, t - 1, 1) for t in range(1, 20, 2)]


def test_a_round_of_refinement_reads_its_pairs_once(spark, monkeypatch):
    fit, seen = tracks.fit_affine, []
    monkeypatch.setattr(tracks, "fit_affine", lambda chosen: seen.append(plan(chosen)) or fit(chosen))
    a = spark.range(60).selectExpr("id as frame", "id % 5 as track_id", "cast(id * 7 % 50 as double) as cx", "cast(id * 3 % 40 as double) as cy")
    b = a.withColumn("cx", F.col("cx") + 2).withColumn("cy", F.col("cy") - 3)
    best, error = tracking.refined_affine(a, b, a.selectExpr("frame as frame_a", "frame as frame_b"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))
    assert seen and all("collectmetrics" in p for p in seen)  # the error comes with the map
    assert np.allclose(best, (1, 0, 0, 1, 2, -3), atol=1e-6) and error < 1e-6
