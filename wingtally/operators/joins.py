"""Joins that no equality states alone: nearest in time, intervals, overlaps, nearest lines, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: float, columns: list[str], order: str = "row_id") -> DataFrame:
    """left with the columns of the right row nearest in `at` of the same key, within the tolerance (inclusive); ties go to the earlier.

    Both sides go through one sort by key and time; nothing is compared pair by pair. Null times match nothing."""
    value = F.struct(F.col(at).alias("_at"), F.col(order).alias("_o"), *columns)
    empty = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    both = left.withColumn("_v", empty).withColumn("_side", F.lit(1))
    r = right.where(F.col(at).isNotNull()).select(F.col(key), F.col(at), value.alias("_v"), F.lit(0).alias("_side"), F.col(order).alias("_r"))
    both = both.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(at), F.col("_side"), F.col("_r"))
    back = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("_side"), F.col("_r").desc())
    low = F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.last("_v", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_low", low).withColumn("_high", high).where("_side = 1")
    d_low, d_high = F.col(at) - F.col("_low._at"), F.col("_high._at") - F.col(at)
    best = F.when(d_low.isNull() | (d_high < d_low), F.col("_high")).otherwise(F.col("_low"))
    out = out.withColumn("_best", best).withColumn("_best", F.when(F.abs(F.col("_best._at") - F.col(at)) <= tolerance, F.col("_best")))
    return out.select(*left.columns, *(F.col(f"_best.{c}").alias(f"near_{c}") for c in columns), F.abs(F.col("_best._at") - F.col(at)).alias("near_dt"))


def positional(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, columns: list[str]) -> DataFrame:
    """The i-th left row of a key with the i-th right row; what is over stays unmatched."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(left_by)))
    b = right.select(key, *columns, F.row_number().over(Window.partitionBy(key).orderBy(right_by)).alias("_i"))
    return a.join(b, [key, "_i"], "left").drop("_i")


def interval_first(rows: DataFrame, ranges: DataFrame, at: str, key: str, columns: list[str], default: dict, order: str = "ord", width: int = 256) -> DataFrame:
    """rows with the columns of the first range (by order) of their key that holds `at`, both ends included, else the defaults.

    Ranges are cut at multiples of `width`, so rows and ranges meet on equal cells; an open end reaches the last row of its key."""
    last = rows.groupBy(key).agg(F.max(at).alias("_max"), F.min(at).alias("_min"))
    r = ranges.join(last, key).withColumn("_s", F.greatest(F.col("start_frame"), F.col("_min"))).withColumn("_e", F.least(F.coalesce(F.col("end_frame"), F.col("_max")), F.col("_max"))).where("_s <= _e")
    cells = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width)))).select(key, "_cell", "_s", "_e", F.struct(F.col(order).alias("_o"), *columns).alias("_v"))
    points = rows.select(key, at).distinct().withColumn("_cell", F.floor(F.col(at) / width))
    hit = points.join(cells, [key, "_cell"]).where(F.col(at).between(F.col("_s"), F.col("_e"))).groupBy(key, at).agg(F.min("_v").alias("_v"))
    out = rows.join(hit, [key, at], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_v.{c}"), F.lit(default[c])))
    return out.drop("_v")


def overlap_join(a: DataFrame, b: DataFrame, cell: float, key: str | None = None, with_boxes: bool = False) -> DataFrame:
    """Pairs of boxes (a_id, b_id; with_boxes also their corners) that touch or overlap, by cells of a grid; a pair is made in the cell of its intersection's lower corner alone."""

    def cells(d: DataFrame, p: str) -> DataFrame:
        d = d.select(*[key] * bool(key), F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")))
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return d.withColumn("_cx", span(f"{p}_x1", f"{p}_x2")).withColumn("_cy", span(f"{p}_y1", f"{p}_y2"))

    both = cells(a, "a").join(cells(b, "b"), [*[key] * bool(key), "_cx", "_cy"])
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    ok = (F.col("a_x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("a_y2"))
    return both.where(ok & (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))).select(*[key] * bool(key), "a_id", "b_id", *[f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2")] * with_boxes)


def segments(route: DataFrame, key: str = "flight_id") -> DataFrame:
    """The route's segments: seg from 0, start (ax, ay), direction (dx, dy)."""
    w = Window.partitionBy(key).orderBy("frame")
    s = route.select(key, (F.row_number().over(w) - 1).alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"))
    return s.where("dx is not null")


def _projected(px: Column, py: Column) -> tuple[Column, Column, Column]:
    n = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    t = F.when(n < 1e-12, 0.0).otherwise(((px - F.col("ax")) * F.col("dx") + (py - F.col("ay")) * F.col("dy")) / F.nullif(n, F.lit(0.0)))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - F.col("ax") - c * F.col("dx"), py - F.col("ay") - c * F.col("dy")
    return t, c, F.sqrt(ex * ex + ey * ey)


#: Segments of a flight that all its points may meet.
SHORT = 256


def near_segments(points: DataFrame, segs: DataFrame, key: str, px: str, py: str, point: str) -> DataFrame:
    """Pairs of points and segments of their key, among them each point's nearest segment and all that tie with it, by cells of a grid.

    Segments are dealt to the cells that they cross, at a cell size of their flight and at 4, 16, .. times that, until one cell holds
    the flight. A point looks at the finest of these grids on which a cell next to it is crossed: the farthest corner of such a cell bounds
    the distance, and the point meets the segments of the cells within that bound. A point outside the flight's extent looks from the extent's edge.
    Flights of at most SHORT segments have no grid: their points meet all of them, so that nothing but points and segments travels."""
    segs = segs.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    few = points.select(key, point, px, py).join(segs.where(F.col("_n") <= SHORT).drop("_n"), key)
    return few.unionByName(_by_cells(points, segs.where(F.col("_n") > SHORT).drop("_n"), key, px, py, point))


def _by_cells(points: DataFrame, segs: DataFrame, key: str, px: str, py: str, point: str) -> DataFrame:
    """near_segments of flights of any length."""
    lo_x, lo_y = F.least(F.col("ax"), F.col("ax") + F.col("dx")), F.least(F.col("ay"), F.col("ay") + F.col("dy"))
    hi_x, hi_y = F.greatest(F.col("ax"), F.col("ax") + F.col("dx")), F.greatest(F.col("ay"), F.col("ay") + F.col("dy"))
    g = segs.groupBy(key).agg(F.min(lo_x).alias("_x0"), F.min(lo_y).alias("_y0"), F.max(hi_x).alias("_x1"), F.max(hi_y).alias("_y1"), F.count("*").alias("_n"), F.avg(F.greatest(F.abs("dx"), F.abs("dy"))).alias("_m"))
    width, height, top = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.greatest(F.abs("_x0"), F.abs("_x1"), F.abs("_y0"), F.abs("_y1"))
    g = g.withColumn("_c", F.greatest(F.sqrt(width * height / F.col("_n")), F.col("_m") / F.sqrt("_n"), F.greatest(width, height) / F.col("_n"), top * 1e-9, F.lit(1e-6)))
    g = g.withColumn("_w", width / F.col("_c")).withColumn("_h", height / F.col("_c"))
    g = g.withColumn("_top", F.ceil(F.log(4.0, F.greatest("_w", "_h") + 2)).cast("int")).drop("_n", "_m", "_x1", "_y1")
    e = 1e-5  # cells, far over what rounding moves
    cell = lambda x: F.greatest(F.lit(0).cast("long"), F.floor(x))
    s = segs.join(g, key).withColumn("_u", (F.col("ax") - F.col("_x0")) / F.col("_c")).withColumn("_v", (F.col("ay") - F.col("_y0")) / F.col("_c"))
    s = s.withColumn("_du", F.col("dx") / F.col("_c")).withColumn("_dv", F.col("dy") / F.col("_c"))
    s = s.withColumn("_i", F.explode(F.sequence(cell(F.least(F.col("_u"), F.col("_u") + F.col("_du")) - e), cell(F.greatest(F.col("_u"), F.col("_u") + F.col("_du")) + e))))
    part = lambda x, other: F.when(F.abs("_du") < e, other).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("_u")) / F.nullif(F.col("_du"), F.lit(0.0)))))
    v0, v1 = (F.col("_v") + t * F.col("_dv") for t in (part(F.col("_i") - e, 0.0), part(F.col("_i") + 1 + e, 1.0)))
    s = s.withColumn("_v0", F.least(v0, v1)).withColumn("_v1", F.greatest(v0, v1)).withColumn("_j", F.explode(F.sequence(cell(F.col("_v0") - e), cell(F.col("_v1") + e))))
    s = s.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumn("_size", F.pow(F.lit(4.0), F.col("_level")))
    s = s.select(*segs.columns, "_level", F.floor(F.col("_i") / F.col("_size")).alias("_i"), F.floor(F.col("_j") / F.col("_size")).alias("_j")).distinct()
    # the finest grid with a crossed cell next to the point, and the bound there
    p = points.select(key, point, px, py).join(g, key).withColumn("_pu", (F.col(px) - F.col("_x0")) / F.col("_c")).withColumn("_pv", (F.col(py) - F.col("_y0")) / F.col("_c"))
    q = p.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumn("_size", F.pow(F.lit(4.0), F.col("_level")))
    for at, c, most in (("_i", "_pu", "_w"), ("_j", "_pv", "_h")):
        here = F.floor(F.greatest(F.lit(0.0), F.least(F.col(most), F.col(c))) / F.col("_size"))
        q = q.withColumn(at, F.explode(F.sequence(cell(here - 1), here + 1)))
    far = lambda c, at: F.greatest(F.abs(F.col(c) - F.col(at) * F.col("_size")), F.abs(F.col(c) - (F.col(at) + 1) * F.col("_size")))
    q = q.join(s.select(key, "_level", "_i", "_j").distinct(), [key, "_level", "_i", "_j"], "left_semi")
    q = q.withColumn("_d", F.sqrt(far("_pu", "_i") * far("_pu", "_i") + far("_pv", "_j") * far("_pv", "_j")) + 1e-3)
    q = q.groupBy(key, point).agg(F.min(F.struct("_level", "_d")).alias("_b")).select(key, point, "_b._level", "_b._d")
    q = p.join(q, [key, point]).withColumn("_size", F.pow(F.lit(4.0), F.col("_level")))
    for at, c, most in (("_i", "_pu", "_w"), ("_j", "_pv", "_h")):
        last = F.least(F.col(c) + F.col("_d"), F.col(most) + 1)
        q = q.withColumn(at, F.explode(F.sequence(cell((F.col(c) - F.col("_d")) / F.col("_size")), cell(last / F.col("_size")))))
    gap = lambda c, at: F.greatest(F.lit(0.0), F.col(at) * F.col("_size") - F.col(c), F.col(c) - (F.col(at) + 1) * F.col("_size"))
    q = q.where(gap("_pu", "_i") * gap("_pu", "_i") + gap("_pv", "_j") * gap("_pv", "_j") <= F.col("_d") * F.col("_d")).select(key, point, px, py, "_level", "_i", "_j")
    return q.join(s, [key, "_level", "_i", "_j"]).drop("_level", "_i", "_j")


def nearest_on_route(points: DataFrame, segs: DataFrame, key: str = "flight_id", px: str = "px", py: str = "py", point: str = "point_id") -> DataFrame:
    """points with seg, foot_x, foot_y and distance of the nearest place on their flight's route; the first segment on ties. Points meet segments of cells near them."""
    j = near_segments(points, segs, key, px, py, point)
    _, c, d = _projected(F.col(px), F.col(py))
    value = F.struct(F.round(d, 9).alias("_d"), F.col("seg"), (F.col("ax") + c * F.col("dx")).alias("foot_x"), (F.col("ay") + c * F.col("dy")).alias("foot_y"), d.alias("distance"))
    best = j.groupBy(key, point).agg(F.min(value).alias("_v"))
    return points.join(best.select(key, point, "_v.seg", "_v.foot_x", "_v.foot_y", "_v.distance"), [key, point], "left")


def perpendicular(points: DataFrame, segs: DataFrame, key: str = "flight_id", point: str = "point_id") -> DataFrame:
    """points (px, py, camera_x, camera_y) with the foot on the line through the segment that is nearest to the camera, and the distance."""
    near = nearest_on_route(points, segs, key, "camera_x", "camera_y", point).select(key, point, "px", "py", "seg")
    j = near.join(segs, [key, "seg"])
    t, _, _ = _projected(F.col("px"), F.col("py"))
    fx, fy = F.col("ax") + t * F.col("dx"), F.col("ay") + t * F.col("dy")
    d = F.sqrt((F.col("px") - fx) * (F.col("px") - fx) + (F.col("py") - fy) * (F.col("py") - fy))
    return j.select(key, point, "seg", fx.alias("foot_x"), fy.alias("foot_y"), d.alias("distance"))


def assign_to_transects(points: DataFrame, lines: DataFrame, truncation: float = 0.0, key: str = "flight_id", point: str = "point_id") -> DataFrame:
    """points with the transect of the nearest centre line (the smaller id on ties), its distance, and truncated: whether that is over the truncation; transect_id is then -1.

    lines: key, transect_id and segments (ax, ay, dx, dy)."""
    _, _, d = _projected(F.col("px"), F.col("py"))
    per = near_segments(points, lines, key, "px", "py", point).groupBy(key, point, "transect_id").agg(F.min(d).alias("_d"))
    best = per.groupBy(key, point).agg(F.min(F.struct(F.round("_d", 9).alias("r"), "transect_id", "_d")).alias("v"))
    far = F.lit(truncation > 0) & (F.col("v._d") > truncation)
    out = best.select(key, point, F.when(far, -1).otherwise(F.col("v.transect_id")).alias("transect_id"), F.col("v.transect_id").alias("nearest"), F.col("v._d").alias("distance"), far.alias("truncated"))
    return points.join(out, [key, point], "left")


def fill_gaps(log: DataFrame, other: DataFrame, gap: float, key: str = "flight_id", at: str = "t") -> DataFrame:
    """log and, where it pauses for over `gap`, the rows of other in between. Gaps and rows meet in one sort by time."""
    w = Window.partitionBy(key).orderBy(at, "_side")
    both = log.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    before = F.last(F.when(F.col("_side") == 0, F.col(at)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col("_side") == 0, F.col(at)), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_b", before).withColumn("_a", after)
    return out.where((F.col("_side") == 0) | ((F.col("_a") - F.col("_b") > gap) & (F.col(at) > F.col("_b")) & (F.col(at) < F.col("_a")))).drop("_b", "_a").withColumnRenamed("_side", "filled")
