"""Projections there and back, published places, and rasters turned from one grid to another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingtally.functions import projections as pr
from wingtally.operators import rasters

ALL = [pr.Geographic(), pr.WebMercator(), pr.of(32633), pr.of(32719), pr.of(25832), pr.TransverseMercator(16 + 1 / 3, 1.0, 0.0, -5_000_000.0), pr.TransverseMercator(-2.0, 0.9996012717, 400_000.0, -100_000.0, 49.0), pr.of(3034), pr.of(2154), pr.LambertConformal(-20.0, -40.0, -30.0, 135.0), pr.LambertConformal(46.0, 46.0, 46.0, 13.0)]


@pytest.mark.parametrize("p", ALL, ids=str)
def test_there_and_back(spark, p):
    middle = getattr(p, "meridian", 14.0)
    low, high = (-60.0, -5.0) if getattr(p, "first", 1) < 0 or getattr(p, "north", 0) == 10_000_000 else (1.0, 70.0)
    d = spark.range(200).selectExpr(f"{low} + id * {(high - low) / 200} as lat", f"{middle} - 3 + id % 13 * 0.5 as lon")
    x, y = p.forward(F.col("lat"), F.col("lon"))
    d = d.withColumns({"x": x, "y": y})
    lat, lon = p.inverse(F.col("x"), F.col("y"))
    d = d.withColumns({"lat2": lat, "lon2": lon})
    x2, y2 = p.forward(F.col("lat2"), F.col("lon2"))
    off = d.select(F.max(F.abs(F.col("lat") - F.col("lat2"))).alias("lat"), F.max(F.abs(F.col("lon") - F.col("lon2"))).alias("lon")).first()
    assert off.lat < 1e-10 and off.lon < 1e-10
    metres = 1 if not isinstance(p, pr.Geographic) else 111_000
    assert d.select(F.max(F.hypot(x2 - F.col("x"), y2 - F.col("y"))) * metres).first()[0] < 1e-5
    # conformal: a step north and a step east come out equally long
    if not isinstance(p, pr.Geographic):
        n = p.forward(F.lit(low + 30) + 1e-5, F.lit(middle + 1.0))
        o, e = p.forward(F.lit(low + 30), F.lit(middle + 1.0)), p.forward(F.lit(low + 30), F.lit(middle + 1.0) + 1e-5)
        a, b, c = spark.range(1).select(F.array(*o), F.array(*n), F.array(*e)).first()
        north, east = np.subtract(b, a), np.subtract(c, a)
        assert abs(north @ east) / (np.linalg.norm(north) * np.linalg.norm(east)) < 1e-6


def test_published_places(spark):
    # The guidance note's example of a cone through two parallels, in metres.
    foot = 0.30480060960121924
    texas = pr.LambertConformal(28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99.0, 2_000_000 * foot, 0.0, 6378206.4, 1 / 294.97870)
    got = spark.range(1).select(*texas.forward(F.lit(28.5), F.lit(-96.0))).first()
    assert [v / foot for v in got] == pytest.approx([2963503.91, 254759.80], abs=0.01)
    web = spark.range(1).select(*pr.WebMercator().forward(F.lit(24 + 22 / 60 + 54.433 / 3600), F.lit(-(100 + 20 / 60)))).first()
    assert list(web) == pytest.approx([-11169055.58, 2800000.0], abs=0.01)
    assert spark.range(1).select(*pr.WebMercator().forward(F.lit(90.0), F.lit(0.0))).first()[1] is None
    with pytest.raises(ValueError):
        pr.of(31287)


def test_a_warped_plane_is_its_formula(spark):
    utm, cone = pr.of(32633), pr.of(3034)
    grid = {"min_x": 425_000.0, "max_y": 5_318_000.0, "cell": 10.0}
    plane = lambda x, y: 3 + 0.01 * (x - 425_000.0) - 0.02 * (y - 5_318_000.0)
    cells = spark.range(120 * 120).selectExpr("id div 120 as row", "id % 120 as col").withColumn("value", plane(grid["min_x"] + (F.col("col") + 0.5) * 10, grid["max_y"] - (F.col("row") + 0.5) * 10))
    o = pr.reprojected(spark.createDataFrame([(425_300.0, 5_317_600.0)], "x double, y double"), "x", "y", utm, cone).first()
    out = {"min_x": o[0], "max_y": o[1], "cell": 7.0, "width": 60, "height": 50}
    got = rasters.warped(cells, grid, utm, out, cone)
    at = got.withColumns({"x": out["min_x"] + (F.col("col") + 0.5) * 7, "y": out["max_y"] - (F.col("row") + 0.5) * 7})
    at = pr.reprojected(at, "x", "y", cone, utm)
    assert got.count() == 3000
    assert at.select(F.max(F.abs(F.col("value") - plane(F.col("x"), F.col("y"))))).first()[0] < 1e-6
    near = rasters.warped(cells, grid, utm, out, cone, nearest=True)
    assert near.count() == 3000 and near.join(got.withColumnRenamed("value", "v"), ["row", "col"]).select(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] <= 0.16
    holes = cells.where("not (row = 60 and col = 60)")
    left = rasters.warped(holes, grid, utm, out, cone).count()
    assert 3000 - 20 < left < 3000
    assert rasters.warped(cells.where("false"), grid, utm, out, cone).count() == 0
