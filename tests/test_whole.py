"""Queries run over whole tables, and joins by cells give the rows of all pairs."""

import math
import random

import pytest

from wingtally import catalog, plans
from wingtally.operators import estimators, joins

SF = "/root/testdata/sf0.001"


def test_queries_see_every_box(spark):
    boxes = plans.detections(spark, SF)
    n = boxes.count()
    assert catalog.QUERIES["sampled_heights"](spark, SF).count() == catalog.QUERIES["boxes_on_ground"](spark, SF).count() == n
    assert catalog.QUERIES["mosaic_average"](spark, SF).agg({"layers": "sum"}).first()[0] == n
    assert all(catalog.QUERIES[q](spark, SF).count() == n for q in ("tracker_hungarian", "tracker_greedy", "tracker_each"))


def test_queries_see_every_flight(spark):
    t = plans.telemetry(spark, SF)
    assert catalog.QUERIES["merged_subtitles"](spark, SF).count() == t.count()
    assert catalog.QUERIES["clock_offsets"](spark, SF).count() == t.select("flight_id").distinct().count()
    assert catalog.QUERIES["stitched_fragments"](spark, SF).count() > 0


def test_a_track_has_one_box_of_a_frame(spark):
    t = catalog.QUERIES["tracker_greedy"](spark, SF)
    assert t.groupBy("flight_id", "frame", "track_id").count().where("count > 1").isEmpty() and t.select("flight_id", "track_id").distinct().count() < t.count()


def routes(rng):
    return {
        "rows": [(i * 40.0 if i // 10 % 2 else 400 - i * 40.0, i // 10 * 30.0) for i in range(120)],
        "wild": [(rng.uniform(0, 9000), rng.uniform(-4000, 2000)) for _ in range(90)],
        "line": [(5e5 + 7.5 * i, 5.3e6) for i in range(60)], "steep": [(1e-7 * i, 11.0 * i) for i in range(60)],
        "still": [(3.0, 4.0)] * 5, "back and forth": [(100.0 * (i % 2), 0.0) for i in range(40)], "one": [(0.0, 0.0), (10.0, 10.0)],
    }


def test_nearest_lines_match_all_pairs(spark):
    rng = random.Random(4)
    path = [(k, i, x, y) for k, r in routes(rng).items() for i, (x, y) in enumerate(r)]
    segs = joins.segments(spark.createDataFrame(path, "flight_id string, frame long, x double, y double")).withColumn("transect_id", catalog.F.floor(catalog.F.col("seg") / 4))
    points = []
    for k, r in routes(random.Random(4)).items():
        wide = max(max(abs(x - r[0][0]), abs(y - r[0][1])) for x, y in r) + 10
        at = [(x + dx, y + dy) for x, y in rng.sample(r, min(len(r), 30)) for dx, dy in ((0.0, 0.0), (rng.gauss(0, 30), rng.gauss(0, 30)))]
        at += [(r[0][0] + rng.uniform(-3, 3) * wide, r[0][1] + rng.uniform(-3, 3) * wide) for _ in range(20)]
        points += [(k, i, *p) for i, p in enumerate(at)]
    pts = spark.createDataFrame(points, "flight_id string, point_id long, px double, py double")
    lines = {}
    for s in segs.collect():
        lines.setdefault(s.flight_id, []).append(s)

    def away(s, x, y):
        n = s.dx * s.dx + s.dy * s.dy
        t = max(0.0, min(1.0, ((x - s.ax) * s.dx + (y - s.ay) * s.dy) / n if n >= 1e-12 else 0.0))
        return math.sqrt((x - s.ax - t * s.dx) ** 2 + (y - s.ay - t * s.dy) ** 2)

    got = {(r.flight_id, r.point_id): r for r in joins.nearest_on_route(pts, segs).collect()}
    dealt = {(r.flight_id, r.point_id): r for r in joins.assign_to_transects(pts, segs, 50.0).collect()}
    assert len(got) == len(dealt) == len(points)
    for k, i, x, y in points:
        far = [away(s, x, y) for s in lines[k]]
        assert got[k, i].distance == pytest.approx(min(far), abs=1e-7) and far[got[k, i].seg] <= min(far) + 2e-9
        assert got[k, i].seg <= min(s.seg for s in lines[k] if far[s.seg] < min(far) + 1e-10)
        assert dealt[k, i].distance == pytest.approx(min(far), abs=1e-7) and dealt[k, i].truncated == (dealt[k, i].distance > 50)


def test_nearest_lines_meet_few_pairs(spark):
    path = [("a", i, (i % 50) * 20.0 if i // 50 % 2 else 980 - (i % 50) * 20.0, i // 50 * 30.0) for i in range(3000)]
    segs = joins.segments(spark.createDataFrame(path, "flight_id string, frame long, x double, y double"))
    pts = spark.createDataFrame([(k, i, x + 9, y - 7) for k, i, x, y in path], "flight_id string, point_id long, px double, py double")
    assert joins.near_segments(pts, segs, "flight_id", "px", "py", "point_id").count() < 3000 * 60
    plan = joins.nearest_on_route(pts, segs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_estimates_use_all_transects_and_resamples(spark):
    rows = catalog._strata(spark, SF)
    assert sorted(catalog.QUERIES["bootstrap_density"](spark, SF).collect()) == sorted(estimators.bootstrap(rows, 999).collect())
    fitted = estimators.zinb(rows.selectExpr("stratum", "greatest(count - 8, 0) as count", "area_ha"))
    want = {r.stratum: r.density for r in fitted.collect()}
    assert {r.stratum: r.density for r in catalog.QUERIES["zero_inflated_density"](spark, SF).collect()} == pytest.approx(want, rel=1e-4)
