import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wingtally.functions import boxes, geodesy, optics
from wingtally.operators import assignment, estimators, joins, paths, rasters, tracking, tracks


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 10), min_size=4, max_size=4), min_size=1, max_size=5))
def test_assignment_is_optimal(cost):
    c = np.array(cost)
    a = c if c.shape[0] <= c.shape[1] else c.T
    best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert sum(c[r, k] for r, k in assignment.optimal(c)) == pytest.approx(best)


def test_two_animals(spark):
    """Two animals cross eight boxes of four frames."""
    a = [(0, 0, 0, 10, 10), (0, 50, 50, 60, 60), (1, 1, 1, 11, 11), (1, 51, 51, 61, 61), (2, 2, 2, 12, 12), (3, 3, 3, 13, 13), (3, 52, 52, 62, 62), (3, 90, 90, 99, 99)]
    d = rows(spark, [(1, f, i, float(x1), float(y1), float(x2), float(y2), 0) for i, (f, x1, y1, x2, y2) in enumerate(a)], "flight_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, class_id long")
    ids = lambda **k: [r.track_id for r in tracking.track_boxes(d, **k).orderBy("row_id").collect()]
    for mode in ("greedy", "hungarian", "hungarian_center"):
        assert ids(mode=mode) == [1, 2, 1, 2, 1, 1, 2, 3]
        assert ids(mode=mode, max_age=0) == [1, 2, 1, 2, 1, 1, 3, 4]


def test_class_gate():
    found, classes = np.array([[0, 0, 5, 5.0]]), np.array([1])
    for aware, want in ((True, 2), (False, 1)):
        t = assignment.Tracker(class_aware=aware)
        t.frame(found, np.array([0]))
        assert t.frame(found, classes).tolist() == [want]
    with pytest.raises(ValueError):
        assignment.Tracker(least=0)


def test_overlap_matrix():
    a, b = np.array([[0, 0, 2, 2.0]]), np.array([[1, 1, 3, 3], [0, 0, 2, 2], [5, 5, 6, 6], [2, 2, 2, 2.0]])
    assert assignment.iou_matrix(a, b)[0].tolist() == pytest.approx([1 / 7, 1, 0, 0])


def test_gap_interpolation(spark):
    t = rows(spark, [(1, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 0.3, 0), (1, 1, 3, 1, 3.0, 0.0, 4.0, 1.0, 0.6, 1), (1, 2, 1, 2, 5.0, 5.0, 6.0, 6.0, 0.5, 0)], "flight_id long, track_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id long")
    mean = paths.interpolate_tracks(t).orderBy("frame", "track_id").collect()
    assert [r.frame for r in mean] == [0, 1, 1, 2, 3] and [r.x1 for r in mean if r.interpolated] == pytest.approx([1.0, 2.0]) and {r.class_id for r in mean if r.interpolated} == {1}
    line = paths.interpolate_tracks(t, "linear").where("interpolated").orderBy("frame").collect()
    assert [r.confidence for r in line] == pytest.approx([0.4, 0.5]) and {r.class_id for r in line} == {0}


def test_path_with_a_gap(spark):
    r = rows(spark, [(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, None, None), (1, 3, 3.0, 8.0), (1, 4, 3.0, 8.0)], "flight_id long, frame long, x double, y double")
    assert [x.cum for x in paths.cumulative_distances(r).orderBy("frame").collect()] == [0, 5, 5, 9, 9]


def test_splits(spark):
    cum = paths.cumulative_distances(rows(spark, [(1, i, float(i), 0.0) for i in range(11)], "flight_id long, frame long, x double, y double"))
    pairs = lambda d: [(r.start_frame, r.end_frame) for r in d.orderBy("transect_id").collect()]
    assert pairs(paths.split_by_distance(cum, 4.0)) == [(0, 4), (5, 9), (10, 10)]
    assert pairs(paths.split_into(cum, 2)) == [(0, 4), (5, 10)]


def test_route_with_corners(spark):
    route = rows(spark, [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (20.0, 10.0)])], "flight_id long, frame long, x double, y double")
    pts = rows(spark, [(1, 0, 5.0, 3.0, 8.0, 0.5), (1, 1, 12.0, 3.0, 8.0, 0.5)], "flight_id long, point_id long, px double, py double, camera_x double, camera_y double")
    near = joins.nearest_on_route(pts, joins.segments(route)).orderBy("point_id").collect()
    assert [r.distance for r in near] == pytest.approx([3, 2]) and [r.seg for r in near] == [0, 1]
    perp = joins.perpendicular(pts, joins.segments(route)).orderBy("point_id").collect()
    assert (perp[1].foot_x, perp[1].foot_y, perp[1].distance) == pytest.approx((12, 0, 3))
    assert paths.route_length(route).first().length == 30


def test_asof_ties_and_tolerance(spark):
    left = rows(spark, [(1, i, t) for i, t in enumerate([0.0, 1.0, 2.0, 5.0, None])], "flight_id long, row_id long, t double")
    right = rows(spark, [(1, i, t) for i, t in enumerate([0.02, 0.98, 3.0, None])], "flight_id long, row_id long, t double").withColumn("id", F.col("row_id"))
    out = joins.asof_nearest(left, right, "flight_id", "t", 0.1, ["id"]).orderBy("row_id").collect()
    assert [r.near_id for r in out] == [0, 1, None, None, None]
    tie = joins.asof_nearest(left.where("row_id = 2"), rows(spark, [(1, 0, 1.5), (1, 1, 2.5)], "flight_id long, row_id long, t double").withColumn("id", F.col("row_id")), "flight_id", "t", 1.0, ["id"]).first()
    assert tie.near_id == 0


def test_first_interval_wins(spark):
    frames = rows(spark, [(1, i) for i in range(6)], "flight_id long, frame long")
    ranges = rows(spark, [(1, 0, 2, 4, 7.0), (1, 1, 3, None, 9.0)], "flight_id long, ord int, start_frame long, end_frame long, tx double")
    out = joins.interval_first(frames, ranges, "frame", "flight_id", ["tx"], {"tx": 0.0}, width=2).orderBy("frame").collect()
    assert [r.tx for r in out] == [0, 0, 7, 7, 7, 9]


def test_utm_and_convergence(spark):
    p = spark.range(1)
    e, n = geodesy.to_utm(F.lit(48.0), F.lit(14.0), 32633)
    r = p.select(e.alias("e"), n.alias("n"), *[geodesy.convergence(F.lit(48.0), F.lit(x), 32633).alias(f"c{int(x)}") for x in (14.0, 15.0, 16.0)]).first()
    assert r.e == pytest.approx(425405, abs=2) and r.n == pytest.approx(5316784, abs=2)
    assert r.c15 == pytest.approx(0, abs=1e-6) and abs(r.c14) == pytest.approx(0.743, abs=2e-3) and r.c16 == pytest.approx(-r.c14, abs=1e-6)
    with pytest.raises(ValueError):
        geodesy.zone(3035)


def test_forward_vector(spark):
    for t, h in itertools.product((0.0, 45.0, 80.0), (0.0, 120.0)):
        f, _, _ = optics.basis(F.lit(t), F.lit(h))
        a, b = math.radians(t), math.radians(h)
        assert list(spark.range(1).select(*f).first()) == pytest.approx([math.sin(a) * math.sin(b), math.sin(a) * math.cos(b), -math.cos(a)])


def test_candidates_and_gates(spark):
    c = rows(spark, [(1, 11, 7, 5.0, 0.9, 0.9), (1, 12, 8, 27.9, 0.9, 0.9), (2, 11, 8, 28.0, 0.9, 0.9), (2, 12, 9, 1.0, 0.1, 0.9)], "track_t long, track_w long, shared long, median_dist double, conf_t double, conf_w double")
    assert [r.rejected for r in tracks.gate(c).orderBy("track_t", "track_w").collect()] == ["shared", None, "distance", "confidence"]
    c = rows(spark, [(0, 1, 11, 1.0, None), (0, 1, 12, 2.0, None), (0, 2, 11, 2.0, None), (0, 2, 12, 9.0, None)], "flight_id int, track_t long, track_w long, median_dist double, rejected string")
    assert {(r.track_t, r.track_w) for r in tracking.assign(c).where("accepted").collect()} == {(1, 12), (2, 11)}


def test_affine_recovery(spark):
    rng = np.random.default_rng(0)
    p = rng.random((40, 2)) * 100
    data = [(x, y, 0.8 * x + 0.05 * y + 30, -0.05 * x + 0.8 * y - 12) for x, y in p.tolist()]
    assert tracks.fit_affine(rows(spark, data, "ax double, ay double, bx double, by double")) == pytest.approx((0.8, 0.05, -0.05, 0.8, 30, -12))
    assert tracks.fit_affine(rows(spark, [(float(i), float(i), 0.0, 0.0) for i in range(5)], "ax double, ay double, bx double, by double")) is None


def test_half_normal_recovery():
    x = np.abs(np.random.default_rng(3).normal(0, 12, 2000))
    assert estimators.fit_detection(x[x <= 60], 60.0)["sigma"] == pytest.approx(12, rel=0.06)


def test_zero_inflated_mean(spark):
    rng = np.random.default_rng(5)
    data = [(1, int(rng.poisson(3 * a / 10)) * int(rng.random() > 0.3), float(a)) for a in rng.uniform(5, 15, 60)]
    t = rows(spark, data, "stratum long, count long, area_ha double")
    z, n = estimators.zinb(t).first(), estimators.naive(t).first()
    assert z.density == pytest.approx(n.density, rel=0.15) and z.error is None and z.se > 0
    assert estimators.zinb(t.limit(3)).first().error
    b = estimators.bootstrap(t).first()
    assert b.low < n.density < b.high and b.density == pytest.approx(n.density, rel=0.05)


def test_rasters(spark):
    three = rows(spark, [(0.0, 0.0), (50.0, 20.0), (52.0, 22.0)], "x double, y double")
    assert rasters.density(three, 5.0, 20.0).agg(F.sum("density")).first()[0] * 25 / 1e4 == pytest.approx(3, rel=5e-3)
    square = lambda x: F.array(*[F.struct(F.lit(a + x).alias("x"), F.lit(b + x).alias("y")) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])
    both = spark.range(1).select(F.lit(1).alias("k"), F.explode(F.array(square(0.0), square(5.0))).alias("ring"))
    cells = rasters.coverage(both)
    assert cells.where("n = 2").count() == 25 and cells.count() == 175
    assert rasters.union_area(both, "k", 1.0).first().area == pytest.approx(175)
    h = rows(spark, [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 9.0)], "row long, col long, z double")
    pts = rows(spark, [(0.0, 0.999999), (0.5, 0.5), (0.25, 0.25), (0.75, 0.75), (5.0, 5.0)], "px double, py double")
    z = {(r.px, r.py): r.z for r in rasters.sampled(h, pts, 1.0).collect()}
    assert z[0.5, 0.5] == pytest.approx(1.5) and z[0.25, 0.25] == pytest.approx(0.75) and z[0.75, 0.75] == pytest.approx(5.25) and z[5.0, 5.0] is None
    v, f = rasters.heightfield_mesh(h, 2, 2, 1.0)
    assert f.count() == 2 and rasters.vertex_normals(v, f).count() == 4


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    got = [spark.range(1).select(boxes.inside_ring(F.lit(x), F.lit(y), ring)).first()[0] for x, y in ((1.0, 1.0), (2.0, 3.0), (4.0, 2.0), (0.0, 0.0), (5.0, 1.0))]
    assert got == [True, False, True, True, False]


def test_colour(spark):
    assert len({spark.range(1).select(optics.colour_of(F.lit(i))).first()[0] for i in range(6)}) == 6


def test_savitzky_golay_keeps_parabolas(spark):
    r = rows(spark, [(1, i, 0.5 * i * i - i) for i in range(20)], "flight_id long, frame long, z double")
    assert all(x.z_smooth == pytest.approx(x.z, abs=1e-6) for x in paths.savitzky_golay(r, ["z"]).collect())
