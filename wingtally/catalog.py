"""The engine's queries by name, each with SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plans
from .functions import boxes, geodesy, optics, projections
from .operators import clocks, estimators, georeference, joins, motion, paths, rasters, shots, simplification, terrain, tracking, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "best_partner"
EPSG = 32633


def query(sql: str | None = None):
    """Registers f, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = plans.oracle(sql.strip())
        return f

    return put


def r4(*columns: str):
    return [F.round(F.col(c), 4).alias(c) for c in columns]


def even4(*columns: str):
    """Columns to four places, moved a little first: values between rows end in 5 often, and engines round such ends apart."""
    return [F.round(F.col(c) + 3.12e-6, 4).alias(c) for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------- scalars


@query("""select row_id, round((x1 + x2) / 2, 4) as cx, round((y1 + y2) / 2, 4) as cy, round(x2 - x1, 4) as w, round(y2 - y1, 4) as h,
  round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 4) as diag, round((x2 - x1) * (y2 - y1), 4) as area from det""")
def box_geometry(spark, sf):
    b = boxes.box()
    d = plans.detections(spark, sf)
    return d.select("row_id", boxes.centre_x(b).alias("cx"), boxes.centre_y(b).alias("cy"), boxes.width(b).alias("w"), boxes.height(b).alias("h"), boxes.diagonal(b).alias("diag"), boxes.area(b).alias("area")).select("row_id", *r4("cx", "cy", "w", "h", "diag", "area"))


@query("""select row_id, round(least(x1, x2), 4) as x1, round(least(y1, y2), 4) as y1, round(greatest(x1, x2), 4) as x2, round(greatest(y1, y2), 4) as y2, 5 as corners from det""")
def box_ring_extent(spark, sf):
    d = plans.detections(spark, sf).withColumn("ring", boxes.ring(boxes.box())).withColumn("e", boxes.extent(F.col("ring")))
    return d.select("row_id", *[F.round(f"e.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")], F.size("ring").alias("corners"))


@query("""with p as (select a.frame, a.row_id as a_id, b.row_id as b_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as i,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as s from det a join det b on a.frame = b.frame and a.row_id <> b.row_id),
  r as (select *, row_number() over (partition by a_id order by round((i / (s - i))::float, 5) desc, b_id) as k from p where (i / (s - i))::float >= 0.01::float)
select frame, a_id, b_id, round((i / (s - i))::float::double, 4) as iou from r where k = 1""")
def best_partner(spark, sf):
    return tracks.best_partner(plans.detections(spark, sf), 0.01).withColumn("iou", F.round(F.col("iou").cast("double"), 4))


@query("""select row_id, round(least(x2, 60) - greatest(x1, 10), 4) as w from (select *, greatest(least(x2, 60) - greatest(x1, 10), 0) * greatest(least(y2, 45) - greatest(y1, 5), 0) / ((x2 - x1) * (y2 - y1)) as s from det) where s > 0.8""")
def area_filter(spark, sf):
    b, area = boxes.box(), (10.0, 5.0, 60.0, 45.0)
    inside = boxes.intersection(b, tuple(map(F.lit, area))) / F.nullif(boxes.area(b), F.lit(0.0))
    return plans.detections(spark, sf).where(inside > 0.8).select("row_id", F.round(boxes.width(boxes.clipped(b, area)), 4).alias("w"))


@query("""select row_id, round(sqrt(power(greatest(x1 - 50, 0, 20 - x1), 2) + power(greatest(y1 - 30, 0, 10 - y1), 2)), 4) as dist from det""")
def distance_to_box(spark, sf):
    d = boxes.distance_to(F.col("x1"), F.col("y1"), tuple(map(F.lit, (20.0, 10.0, 50.0, 30.0))))
    return plans.detections(spark, sf).select("row_id", F.round(d, 4).alias("dist"))


@query("""select row_id, round((greatest(x1, 0) + least(x2, 100)) / 200, 6) as cx, round((greatest(y1, 0) + least(y2, 50)) / 100, 6) as cy from det where (least(x2, 100) - greatest(x1, 0)) * (least(y2, 50) - greatest(y1, 0)) >= 20""")
def yolo_boxes(spark, sf):
    b, d = boxes.box(), plans.detections(spark, sf)
    cx, cy, *_ = boxes.to_yolo(b, 100.0, 50.0)
    return d.where(boxes.area(boxes.clipped(b, (0.0, 0.0, 100.0, 50.0))) >= 20).select("row_id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("""select row_id from det where x1 >= 0.5 and y1 >= 0.5 and y1 <= 45 and (x1 - 89.25) * 44.5 + (y1 - 0.5) * 44.5 <= 1e-9""")
def points_in_polygon(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (89.25, 0.5), (44.75, 45.0), (0.5, 45.0))])
    return plans.detections(spark, sf).where(boxes.inside_ring(F.col("x1"), F.col("y1"), ring)).select("row_id")


@query("""select id, round((pitch + 90) % 360 + case when (pitch + 90) % 360 < 0 then 360 else 0 end, 4) as tilt, round((heading + 15) % 360, 4) as heading,
  round(pitch, 4) as pitch from tele""")
def gimbal_angles(spark, sf):
    tilt, _, heading = geodesy.gimbal_to_rotation(F.col("pitch"), F.col("roll"), F.col("heading"), 15.0)
    pitch, _, _ = geodesy.rotation_to_gimbal(tilt, F.col("roll"), heading)
    return plans.telemetry(spark, sf).select("id", F.round(tilt, 4).alias("tilt"), F.round(heading, 4).alias("heading"), F.round(pitch, 4).alias("pitch"))


# Eccentricity, rectifying radius and series coefficients of the WGS 84 ellipsoid, for a conformal latitude by asinh.
_UTM = """u0 as (select *, sinh(asinh(tan(radians(lat))) - 0.0818191908426215e0 * atanh(0.0818191908426215e0 * sin(radians(lat)))) as t, radians(lon - 15) as dl from tele),
  u1 as (select *, atan2(t, cos(dl)) as xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) as eta from u0),
  utm as (select *, 500000 + 0.9996e0 * 6367449.14582341532e0 * (eta + 8.3773182062446983e-4 * cos(2 * xi) * sinh(2 * eta) + 7.608527773572489e-7 * cos(4 * xi) * sinh(4 * eta) + 1.1976455032424921e-9 * cos(6 * xi) * sinh(6 * eta) + 2.42917068e-12 * cos(8 * xi) * sinh(8 * eta) + 5.7118e-15 * cos(10 * xi) * sinh(10 * eta)) as east,
    0.9996e0 * 6367449.14582341532e0 * (xi + 8.3773182062446983e-4 * sin(2 * xi) * cosh(2 * eta) + 7.608527773572489e-7 * sin(4 * xi) * cosh(4 * eta) + 1.1976455032424921e-9 * sin(6 * xi) * cosh(6 * eta) + 2.42917068e-12 * sin(8 * xi) * cosh(8 * eta) + 5.7118e-15 * sin(10 * xi) * cosh(10 * eta)) as north from u1)"""


@query(f"with {_UTM} select id, round(east, 3) as east, round(north, 3) as north from utm")
def utm_forward(spark, sf):
    e, n = geodesy.to_utm(F.col("lat"), F.col("lon"), EPSG)
    return plans.telemetry(spark, sf).select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(f"""with {_UTM} select id, round(east - 425405.337, 2) as x, round(north - 5316784.018, 2) as y, round(lat, 7) as lat, round(lon, 7) as lon, round(alt, 4) as alt from utm""")
def utm_round_trip(spark, sf):
    """Positions in metres from a corner of the grid, and back."""
    e, n = geodesy.to_utm(F.col("lat"), F.col("lon"), EPSG)
    t = plans.telemetry(spark, sf).select("id", (e - 425405.337).alias("x"), (n - 5316784.018).alias("y"), "alt")
    lat, lon = geodesy.from_utm(F.col("x") + 425405.337, F.col("y") + 5316784.018, EPSG)
    return t.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round("alt", 4).alias("alt"))


@query("select id, round(degrees(atan(tan(radians(lon - 15)) * sin(radians(lat)))), 2) as angle from tele")
def grid_convergence(spark, sf):
    return plans.telemetry(spark, sf).select("id", F.round(-geodesy.convergence(F.col("lat"), F.col("lon"), EPSG), 2).alias("angle"))


@query("""select id, round(degrees(asin(sin(radians(lat)) * cos(alt / 6371000) + cos(radians(lat)) * sin(alt / 6371000) * cos(radians(heading)))), 7) as lat2,
  floor((lon + 180) / 360 * 65536)::bigint as tile_x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536)::bigint as tile_y,
  floor(lat)::bigint as deg, floor((lat - floor(lat)) * 60)::bigint as min from tele""")
def sphere_tiles_dms(spark, sf):
    lat2, _ = geodesy.destination(F.col("lat"), F.col("lon"), F.col("alt"), F.col("heading"))
    x, y = geodesy.to_tile(F.col("lat"), F.col("lon"), 16)
    dms = geodesy.to_dms(F.col("lat"))
    return plans.telemetry(spark, sf).select("id", F.round(lat2, 7).alias("lat2"), x.alias("tile_x"), y.alias("tile_y"), dms["deg"].alias("deg"), dms["min"].alias("min"))


@query("""select id, case when alt >= 0 then round(alt / cos(radians(pitch + 90)) * sin(radians(pitch + 90)) * sin(radians(heading)), 4) + 0 end as gx, case when alt >= 0 then round(alt / cos(radians(pitch + 90)) * sin(radians(pitch + 90)) * cos(radians(heading)), 4) + 0 end as gy
from tele""")
def ground_of_centre_pixel(spark, sf):
    t = plans.telemetry(spark, sf)
    gx, gy = optics.pixel_to_ground(F.lit(256.0), F.lit(256.0), (F.lit(0.0), F.lit(0.0), F.col("alt")), F.col("pitch") + 90, F.col("heading"), 50.0, 512.0, 512.0, roll=F.col("roll"))
    return t.select("id", (F.round(gx, 4) + 0).alias("gx"), (F.round(gy, 4) + 0).alias("gy"))


_POSE = """b as (select *, radians(pitch + 90) as t, radians(heading) as h, radians(roll) as w, tan(radians(25)) as k from tele),
  pose as (select *, sin(t) * sin(h) as f0, sin(t) * cos(h) as f1, -cos(t) as f2, cos(w) * cos(h) - sin(w) * cos(t) * sin(h) as r0, -cos(w) * sin(h) - sin(w) * cos(t) * cos(h) as r1, -sin(w) * sin(t) as r2,
    sin(w) * cos(h) + cos(w) * cos(t) * sin(h) as u0, -sin(w) * sin(h) + cos(w) * cos(t) * cos(h) as u1, cos(w) * sin(t) as u2 from b)"""


@query(f"""with {_POSE}, d as (select *, (2 * 100 / 512.0e0 - 1) * k as a, (1 - 2 * 200 / 512.0e0) * k as c from pose), e as (select *, f2 + a * r2 + c * u2 as dz from d), s as (select *, case when dz < 0 and alt >= 0 then -alt / dz end as s from e)
select id, round(s * (f0 + a * r0 + c * u0), 3) as gx, round(s * (f1 + a * r1 + c * u1), 3) as gy, case when s > 0 then 100.0e0 end as px, case when s > 0 then 200.0e0 end as py from s""")
def pixel_round_trip(spark, sf):
    """A pixel's place on flat ground, and the pixel of that place; null where the ray does not go down, or from the ground itself."""
    pos = (F.lit(0.0), F.lit(0.0), F.col("alt"))
    t = plans.telemetry(spark, sf).withColumn("tilt", F.col("pitch") + 90)
    gx, gy = optics.pixel_to_ground(F.lit(100.0), F.lit(200.0), pos, F.col("tilt"), F.col("heading"), 50.0, 512.0, 512.0, roll=F.col("roll"))
    t = t.withColumn("gx", gx).withColumn("gy", gy)
    px, py = optics.world_to_pixel((F.col("gx"), F.col("gy"), F.lit(0.0)), pos, F.col("tilt"), F.col("heading"), 50.0, 512.0, 512.0, F.col("roll"))
    return t.select("id", *[F.round(c, 3).alias(c) for c in ("gx", "gy")], F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query(f"""with {_POSE}, v as (select *, id % 41 - 20 as x, id % 31 - 15 as y from pose), w as (select *, x * f0 + y * f1 - alt * f2 as depth, x * r0 + y * r1 - alt * r2 as side, x * u0 + y * u1 - alt * u2 as up from v)
select id, case when depth > 0 then round((side / (depth * k) + 1) * 256, 3) end as px, case when depth > 0 then round(512 - (up / (depth * k) + 1) * 256, 3) end as py from w""")
def points_in_pictures(spark, sf):
    """Places on the ground as pixels of cameras with tilt, heading and roll; null behind the camera."""
    point = ((F.col("id") % 41 - 20).cast("double"), (F.col("id") % 31 - 15).cast("double"), F.lit(0.0))
    px, py = optics.world_to_pixel(point, (F.lit(0.0), F.lit(0.0), F.col("alt")), F.col("pitch") + 90, F.col("heading"), 50.0, 512.0, 512.0, F.col("roll"))
    return plans.telemetry(spark, sf).select("id", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query(f"""with {_POSE} select id, round(pitch + 90, 4) as tilt, case when pitch > -90 then round(heading, 4) else round((heading + roll + 720) % 360, 4) end as heading, case when pitch > -90 then round(roll, 4) else 0 end as roll, round(r2, 6) + 0 as dip from pose""")
def camera_angles(spark, sf):
    """Angles of cameras from their axes: the inverse of the rotation."""
    f, r, u = optics.basis(F.col("pitch") + 90, F.col("heading"), F.col("roll"))
    tilt, heading, roll = optics.angles(f, r, u)
    whole = F.pmod(F.round(heading, 4), F.lit(360.0))
    return plans.telemetry(spark, sf).select("id", F.round(tilt, 4).alias("tilt"), whole.alias("heading"), F.round(roll, 4).alias("roll"), (F.round(r[2], 6) + 0).alias("dip"))


@query("""select id, round(4 * greatest(alt, 1) * greatest(alt, 1) * power(tan(radians(25)), 2) * 4 / 3, 3) as area from tele""")
def flat_footprints(spark, sf):
    ring = optics.flat_footprint(F.lit(0.0), F.lit(0.0), F.col("alt"), F.col("heading"), 50.0)
    return plans.telemetry(spark, sf).select("id", F.round(boxes.ring_area(ring), 3).alias("area"))


@query("""select row_id, round(0.8 * x1 + 0.05 * y1 + 30, 4) as ax, round(-0.05 * x1 + 0.8 * y1 - 12, 4) as ay, round(exp(-x1 * x1 / 800), 6) as hn,
  round(case when x1 <= 0 then 1 else 1 - exp(-power(x1 / 20, -3)) end, 6) as hr, floor(least(greatest(y1, 0), 40) / 40 * 65535)::bigint as fixed from det""")
def affine_detection_fixed(spark, sf):
    ax, ay = optics.affine(F.col("x1"), F.col("y1"), (0.8, 0.05, -0.05, 0.8, 30.0, -12.0))
    return plans.detections(spark, sf).select(
        "row_id", F.round(ax, 4).alias("ax"), F.round(ay, 4).alias("ay"), F.round(optics.half_normal(F.col("x1"), F.lit(20.0)), 6).alias("hn"),
        F.round(optics.hazard_rate(F.col("x1"), F.lit(20.0), F.lit(3.0)), 6).alias("hr"), optics.fixed_point(F.col("y1"), 0.0, 40.0, 16).alias("fixed"),
    )


@query("""select track_id, row_id, case when greatest(abs(x1 / 50 - 1), abs(y1 / 25 - 1)) <= 0.10 then 'ok' when greatest(abs(x1 / 50 - 1), abs(y1 / 25 - 1)) >= 0.25 then 'error' else 'warn' end as severity from det""")
def calibration_check(spark, sf):
    return plans.detections(spark, sf).select("track_id", "row_id", optics.resolution_check(F.col("x1") / 2, F.col("y1") / 2, F.lit(50.0), F.lit(25.0)).alias("severity"))


# ------------------------------------------------------------------- windows


@query("""select flight_id, frame, round(sum(coalesce(sqrt(power(x - px, 2) + power(y - py, 2)), 0)) over (partition by flight_id order by frame rows unbounded preceding), 3) as cum
from (select *, lag(x) over w as px, lag(y) over w as py from route window w as (partition by flight_id order by frame))""")
def cumulative_path(spark, sf):
    return paths.cumulative_distances(plans.routes(spark, sf)).select("flight_id", "frame", F.round("cum", 3).alias("cum"))


_CUM = """c0 as (select *, lag(x) over w as px, lag(y) over w as py from route window w as (partition by flight_id order by frame)),
  cum as (select flight_id, frame, sum(coalesce(sqrt(power(x - px, 2) + power(y - py, 2)), 0)) over (partition by flight_id order by frame rows unbounded preceding) as cum from c0)"""


@query(f"with {_CUM} select flight_id, round(max(cum), 3) as length from cum group by 1")
def route_lengths(spark, sf):
    return paths.route_length(plans.routes(spark, sf)).select("flight_id", F.round("length", 3).alias("length"))


def _cum(spark, sf):
    return paths.cumulative_distances(plans.routes(spark, sf))


@query(f"""with {_CUM}, r as (select flight_id, transect_id::int as transect_id, transect_id * 10 as s, transect_id * 10 + 9 as e from (select distinct flight_id from route), range(3) t(transect_id)),
  m as (select flight_id, max(frame) as last from cum group by 1)
select r.flight_id, r.transect_id, round(abs(b.cum - a.cum), 3) as length from r join m using (flight_id) join cum a on a.flight_id = r.flight_id and a.frame = least(s, last) join cum b on b.flight_id = r.flight_id and b.frame = least(e, last)""")
def transect_length(spark, sf):
    c = _cum(spark, sf)
    r = c.select("flight_id").distinct().withColumn("transect_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("start_frame", (F.col("transect_id") * 10).cast("long")).withColumn("end_frame", (F.col("transect_id") * 10 + 9).cast("long"))
    return paths.transect_lengths(c, r).select("flight_id", "transect_id", F.round("length", 3).alias("length"))


@query(f"""with {_CUM} select s.flight_id, 2::bigint as start_frame, 20000.0::double as metres, coalesce((select min(frame) from cum c where c.flight_id = s.flight_id and c.cum >= s.cum + 20000), -1) as frame from cum s where s.frame = 2""")
def frame_after(spark, sf):
    c = _cum(spark, sf)
    starts = c.where("frame = 2").select("flight_id", F.col("frame").alias("start_frame"), F.lit(20000.0).alias("metres"))
    return paths.frame_after_distance(c, starts)


@query(f"""with {_CUM}, t as (select flight_id, max(cum) as total, max(frame) as last from cum group by 1), e as (select *, i::int as transect_id from t, range(4) r(i)),
  s as (select e.flight_id, transect_id, last, case when transect_id = 0 then 0 else coalesce((select min(frame) from cum c where c.flight_id = e.flight_id and c.cum >= total * transect_id / 4), 0) end as start_frame from e)
select flight_id, transect_id, start_frame, greatest(coalesce(lead(start_frame) over (partition by flight_id order by transect_id) - 1, last), start_frame) as end_frame from s""")
def split_equal(spark, sf):
    return paths.split_into(_cum(spark, sf), 4)


@query(f"""with {_CUM}, m as (select flight_id, max(frame) as last from cum group by 1),
  cut as (select m.flight_id, 0 as transect_id, 0::bigint as s, coalesce((select min(frame) from cum c where c.flight_id = m.flight_id and c.cum >= 30000), last) as e, last from m
  union all select cut.flight_id, transect_id + 1, cut.e + 1, coalesce((select min(c.frame) from cum c where c.flight_id = cut.flight_id and c.frame >= cut.e + 1 and c.cum >= 30000 + (select b.cum from cum b where b.flight_id = cut.flight_id and b.frame = cut.e + 1)), last), last from cut where cut.e < last)
select flight_id, transect_id, s as start_frame, e as end_frame from cut""")
def split_metres(spark, sf):
    return paths.split_by_distance(_cum(spark, sf), 30000.0)


_TR = "tr as (select track_id % 20 as flight_id, track_id, frame, row_id, x1, y1, x2, y2, confidence, class_id from det)"


def _tracks(spark, sf):
    """All boxes, dealt to 20 flights; a track may have several in one frame."""
    return plans.detections(spark, sf).select((F.col("track_id") % 20).alias("flight_id"), "track_id", "frame", "row_id", "x1", "y1", "x2", "y2", "confidence", "class_id")


@query(f"""with {_TR}, n as (select *, lead(frame) over w as f2, lead(x1) over w as x12, lead(confidence) over w as c2, lead(class_id) over w as k2 from tr window w as (partition by flight_id, track_id order by frame, row_id))
select flight_id, track_id, f as frame, round(x1 + (x12 - x1) * ((f - n.frame) / (f2 - n.frame)) + 3.12e-6, 4) as x1, round((confidence + c2) / 2 + 3.12e-6, 4) as confidence, k2 as class_id from n, lateral (select unnest(range(n.frame + 1, f2)) as f)""")
def interpolated_tracks(spark, sf):
    """Every frame between a track's rows, however long the gap."""
    return paths.interpolate_tracks(_tracks(spark, sf)).where("interpolated").select("flight_id", "track_id", "frame", *even4("x1", "confidence"), "class_id")


@query(f"""with {_TR}, n as (select *, lead(frame) over w as f2, lead(y2) over w as y22, lead(confidence) over w as c2 from tr window w as (partition by flight_id, track_id order by frame, row_id))
select flight_id, track_id, frame, row_id, round(y2 + 3.12e-6, 4) as y2, round(confidence + 3.12e-6, 4) as confidence, class_id, false as interpolated from tr
union all select flight_id, track_id, f, null, round(y2 + (y22 - y2) * ((f - n.frame) / (f2 - n.frame)) + 3.12e-6, 4), round(confidence + (c2 - confidence) * ((f - n.frame) / (f2 - n.frame)) + 3.12e-6, 4), class_id, true from n, lateral (select unnest(range(n.frame + 1, f2)) as f) where f2 - n.frame - 1 <= 24""")
def short_gaps_closed(spark, sf):
    """Tracks whose gaps of at most 24 frames are filled; longer ones stay open."""
    return paths.interpolate_tracks(_tracks(spark, sf), "linear", max_gap=24).select("flight_id", "track_id", "frame", "row_id", *even4("y2", "confidence"), "class_id", "interpolated")


@query("""with s as (select flight_id, epoch(ts) as t, alt, heading from tele), n as (select *, lead(t) over w as t2, lead(alt) over w as a2, lead(heading) over w as h2 from s window w as (partition by flight_id order by t))
select flight_id, k as tick, round(alt + (a2 - alt) * (k * 21600.0 - t) / (t2 - t), 3) as alt, round(sin(radians(heading + (case when h2 - heading >= 180 then h2 - heading - 360 when h2 - heading < -180 then h2 - heading + 360 else h2 - heading end) * (k * 21600.0 - t) / (t2 - t))), 4) as heading_sin, round(cos(radians(heading + (case when h2 - heading >= 180 then h2 - heading - 360 when h2 - heading < -180 then h2 - heading + 360 else h2 - heading end) * (k * 21600.0 - t) / (t2 - t))), 4) as heading_cos from n, lateral (select unnest(range(ceil(t / 21600.0)::bigint, ceil(t2 / 21600.0)::bigint)) as k) where t2 > t""")
def resampled(spark, sf):
    t = plans.telemetry(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return paths.resample(t, 21600.0, ["alt"], ("heading",)).select("flight_id", "tick", F.round("alt", 3).alias("alt"), F.round(F.sin(F.radians("heading")), 4).alias("heading_sin"), F.round(F.cos(F.radians("heading")), 4).alias("heading_cos"))


@query("""select id, round((row_number() over (partition by flight_id, d order by id) - 1) * 1.0 / count(*) over (partition by flight_id, d), 6) as share from (select *, date_trunc('day', ts) as d from tele)""")
def spread_timestamps(spark, sf):
    return paths.spread_seconds(plans.telemetry(spark, sf).withColumn("d", F.date_trunc("day", "ts")), second="d").select("id", F.round("share", 6).alias("share"))


@query("""select flight_id, frame from (select *, lag(is_video) over (partition by flight_id order by frame) as p from tele) where p is null or p <> is_video""")
def without_repeats(spark, sf):
    return paths.without_repeats(plans.telemetry(spark, sf), "is_video").select("flight_id", "frame")


@query("""select flight_id, frame, round((sum(z) over (w rows between 5 preceding and 5 following) + greatest(0, 5 - i) * first_value(z) over w + greatest(0, 5 - (n - 1 - i)) * last_value(z) over (w rows between unbounded preceding and unbounded following)) / 11, 4) as z_smooth
from (select *, row_number() over (partition by flight_id order by frame) - 1 as i, count(*) over (partition by flight_id) as n from route) window w as (partition by flight_id order by frame)""")
def smoothed_path(spark, sf):
    return paths.moving_average(plans.routes(spark, sf), ["z"]).select("flight_id", "frame", F.round("z_smooth", 4).alias("z_smooth"))


@query("""with r as (select flight_id, frame, z, row_number() over (partition by flight_id order by frame) - 1 as i, count(*) over (partition by flight_id) as n from route),
  m as (select *, (least(11, case when n % 2 = 1 then n else n - 1 end) - 1) // 2 as k from r), c as (select *, greatest(k, least(n - 1 - k, i)) as c, (2 * k + 1) * 1.0e0 as s0, k * (k + 1) * (2 * k + 1) / 3.0e0 as s2, k * (k + 1) * (2 * k + 1) * (3 * k * k + 3 * k - 1) / 15.0e0 as s4 from m),
  w as (select c.flight_id, c.frame, sum(p.z * ((s4 - s2 * power(p.i - c, 2)) / (s0 * s4 - s2 * s2) + (c.i - c) * (p.i - c) / s2 + power(c.i - c, 2) * (s0 * power(p.i - c, 2) - s2) / (s0 * s4 - s2 * s2))) as v from c join r p on p.flight_id = c.flight_id and p.i between c.c - k and c.c + k where k > 0 group by all)
select c.flight_id, c.frame, round(coalesce(v, z), 4) as z_smooth from c left join w using (flight_id, frame)""")
def savitzky_golay(spark, sf):
    return paths.savitzky_golay(plans.routes(spark, sf), ["z"]).select("flight_id", "frame", F.round("z_smooth", 4).alias("z_smooth"))


@query("""select flight_id, frame, round(case when dx * dx + dy * dy < 1e-6 then 0 else (degrees(atan2(dx, dy)) + 360) % 360 end, 3) as course
from (select flight_id, frame, coalesce(lead(x) over w - x, x - lag(x) over w, 0) as dx, coalesce(lead(y) over w - y, y - lag(y) over w, 0) as dy from route window w as (partition by flight_id order by frame))""")
def course(spark, sf):
    return paths.heading_from_path(plans.routes(spark, sf)).select("flight_id", "frame", F.round("course", 3).alias("course"))


@query("""select flight_id, min(frame) as start_frame, max(frame) as end_frame, max(is_video) as is_video from (select *, frame - row_number() over (partition by flight_id, is_video order by frame) as g from tele) group by flight_id, is_video, g""")
def video_islands(spark, sf):
    return paths.islands(plans.telemetry(spark, sf), "is_video").groupBy("flight_id", "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max("is_video").alias("is_video")).drop("island")


@query("""select flight_id, count(*) as n from (select *, frame - row_number() over (partition by flight_id order by frame) as g, min(frame) over (partition by flight_id) as f from tele where is_video = 1) where g = f - 1 group by 1""")
def first_video_run(spark, sf):
    return paths.first_run(plans.telemetry(spark, sf), "is_video").groupBy("flight_id").agg(F.count("*").alias("n"))


@query("""select a.flight_id, a.frame as central, b.frame from tele a join tele b on a.flight_id = b.flight_id and abs(a.frame - b.frame) between 10 and 100 and (a.frame - b.frame) % 10 = 0""")
def neighbour_frames(spark, sf):
    t = plans.telemetry(spark, sf)
    return paths.neighbours(t).select("flight_id", "central", "frame")


@query("""select flight_id, frame from tele where frame >= 3 and (frame - 3) % 4 = 0 and (frame - 3) < 40""")
def skip_stride_limit(spark, sf):
    return paths.every_nth(plans.telemetry(spark, sf), 3, 4, 10).select("flight_id", "frame")


# --------------------------------------------------------------------- joins


@query("""with l as (select * from tele where is_video = 1), r as (select * from tele where is_video = 0),
  p as (select l.id, r.id as near_id, epoch(l.ts) - epoch(r.ts) as d from l join r on l.flight_id = r.flight_id and abs(epoch(l.ts) - epoch(r.ts)) <= 21600),
  b as (select *, row_number() over (partition by id order by abs(d), d desc, near_id) as k from p)
select l.id, b.near_id, round(abs(d), 3) as near_dt from l left join b on b.id = l.id and k = 1""")
def nearest_in_time(spark, sf):
    t = plans.telemetry(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select("flight_id", "id", "t", "is_video")
    r = t.where("is_video = 0").withColumn("row_id", F.col("id"))
    out = joins.asof_nearest(t.where("is_video = 1"), r, "flight_id", "t", 21600.0, ["id"])
    return out.select("id", "near_id", F.round("near_dt", 3).alias("near_dt"))


@query("""select a.id, b.id as photo_id from (select *, row_number() over (partition by flight_id order by ts, id) as i from tele where is_video = 1) a left join (select *, row_number() over (partition by flight_id order by id) as i from tele where id % 3 = 0) b on a.flight_id = b.flight_id and a.i = b.i""")
def positional_match(spark, sf):
    t = plans.telemetry(spark, sf)
    b = t.where("id % 3 = 0").select("flight_id", F.col("id").alias("photo_id"))
    a = t.where("is_video = 1").withColumn("o", F.struct("ts", "id"))
    return joins.positional(a, b, "flight_id", "o", "photo_id", ["photo_id"]).select("id", "photo_id")


_RANGES = "ranges as (select flight_id, o as ord, o * 15 + flight_id % 7 as s, case when o = 3 then null else o * 15 + flight_id % 7 + 20 end as e, o * 0.5e0 as tx from (select distinct flight_id from tele), range(4) r(o))"


@query(f"""with {_RANGES} select t.flight_id, t.frame, round(coalesce((select r.tx from ranges r where r.flight_id = t.flight_id and t.frame >= r.s and (r.e is null or t.frame <= r.e) order by ord limit 1), -1.0e0), 2) as tx from tele t""")
def corrections_by_frame(spark, sf):
    t = plans.telemetry(spark, sf)
    r = t.select("flight_id").distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("start_frame", F.col("ord") * 15 + F.col("flight_id") % 7)
    r = r.withColumn("end_frame", F.when(F.col("ord") < 3, F.col("start_frame") + 20)).withColumn("tx", F.col("ord") * 0.5)
    return joins.interval_first(t.select("flight_id", "frame"), r, "frame", "flight_id", ["tx"], {"tx": -1.0}).select("flight_id", "frame", F.round("tx", 2).alias("tx"))


@query("""select a.frame, a.row_id as a_id, b.row_id as b_id from det a join det b on a.frame = b.frame and a.row_id < b.row_id and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2""")
def overlap_pairs(spark, sf):
    d = plans.detections(spark, sf).select("frame", F.col("row_id").alias("id"), "x1", "y1", "x2", "y2")
    return joins.overlap_join(d, d, 10.0, "frame").where("a_id < b_id")


_SEG = "seg as (select * from (select flight_id, row_number() over w - 1 as seg, x as ax, y as ay, lead(x) over w - x as dx, lead(y) over w - y as dy from route window w as (partition by flight_id order by frame)) where dx is not null)"
_POINTS = "pts as (select flight_id, frame as point_id, x + 37.5 as px, y - 12.25 as py, x as camera_x, y as camera_y from route)"
_CLAMP = "greatest(0, least(1, case when dx * dx + dy * dy < 1e-12 then 0 else ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy) end))"


def _points_segments(spark, sf):
    r = plans.routes(spark, sf)
    pts = r.select("flight_id", F.col("frame").alias("point_id"), (F.col("x") + 37.5).alias("px"), (F.col("y") - 12.25).alias("py"), F.col("x").alias("camera_x"), F.col("y").alias("camera_y"))
    return pts, joins.segments(r)


@query(f"""with {_SEG}, {_POINTS}, j as (select *, {_CLAMP} as t from pts join seg using (flight_id)), d as (select *, sqrt(power(px - ax - t * dx, 2) + power(py - ay - t * dy, 2)) as d from j),
  k as (select *, row_number() over (partition by flight_id, point_id order by round(d, 9), seg) as k from d) select flight_id, point_id, seg, round(d, 4) as distance from k where k = 1""")
def nearest_on_route(spark, sf):
    pts, seg = _points_segments(spark, sf)
    return joins.nearest_on_route(pts, seg).where("seg is not null").select("flight_id", "point_id", "seg", F.round("distance", 4).alias("distance"))


@query(f"""with {_SEG}, {_POINTS}, j as (select *, {_CLAMP.replace("px", "camera_x").replace("py", "camera_y")} as t from pts join seg using (flight_id)), d as (select *, sqrt(power(camera_x - ax - t * dx, 2) + power(camera_y - ay - t * dy, 2)) as d from j),
  k as (select *, row_number() over (partition by flight_id, point_id order by round(d, 9), seg) as k from d), u as (select *, case when dx * dx + dy * dy < 1e-12 then 0 else ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy) end as f from k where k = 1)
select flight_id, point_id, seg, round(sqrt(power(px - ax - f * dx, 2) + power(py - ay - f * dy, 2)), 3) as distance from u""")
def perpendicular_distance(spark, sf):
    pts, seg = _points_segments(spark, sf)
    return joins.perpendicular(pts, seg).select("flight_id", "point_id", "seg", F.round("distance", 3).alias("distance"))


@query(f"""with {_SEG}, {_POINTS}, j as (select flight_id, point_id, seg // 4 as transect_id, sqrt(power(px - ax - {_CLAMP} * dx, 2) + power(py - ay - {_CLAMP} * dy, 2)) as d from pts join seg using (flight_id)),
  m as (select flight_id, point_id, transect_id, min(d) as d from j group by all), k as (select *, row_number() over (partition by flight_id, point_id order by round(d, 9), transect_id) as k from m)
select flight_id, point_id, case when d > 500 then -1 else transect_id end as transect_id, transect_id as nearest, d > 500 as truncated from k where k = 1""")
def transect_assignment(spark, sf):
    pts, seg = _points_segments(spark, sf)
    out = joins.assign_to_transects(pts, seg.withColumn("transect_id", F.floor(F.col("seg") / 4)), 500.0)
    return out.where("nearest is not null").select("flight_id", "point_id", "transect_id", "nearest", "truncated")


@query("""with a as (select * from tele where id % 2 = 0), b as (select * from tele where id % 2 = 1), g as (select flight_id, ts, lead(ts) over (partition by flight_id order by ts) as n from a)
select id, 0 as filled from a union all select b.id, 1 from b join g on b.flight_id = g.flight_id and b.ts > g.ts and b.ts < g.n and epoch(g.n) - epoch(g.ts) > 43200""")
def gap_filled_log(spark, sf):
    t = plans.telemetry(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select("flight_id", "id", "t")
    return joins.fill_gaps(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 43200.0).select("id", "filled")


# ------------------------------------------------------- tracks and aggregates


@query(f"""with {_TR}, g as (select flight_id, track_id, class_id, avg(case when confidence >= 0.7 then confidence end) as m, count(*) filter (confidence >= 0.7) as n, min(case when confidence >= 0.7 then frame * 1000000 + row_id % 1000000 end) as f, avg(confidence) as c from tr group by all),
  k as (select *, row_number() over (partition by flight_id, track_id order by round(m, 9) desc nulls last, f nulls last, class_id) as k from g where n > 0)
select t.flight_id, t.track_id, k.class_id, round(coalesce(c, 0) + 1e-7, 5) as confidence from (select distinct flight_id, track_id from tr) t left join k on k.flight_id = t.flight_id and k.track_id = t.track_id and k = 1""")
def class_votes(spark, sf):
    return tracks.class_vote(_tracks(spark, sf)).select("flight_id", "track_id", "class_id", F.round(F.col("confidence") + 1e-7, 5).alias("confidence"))


@query(f"""with {_TR}, c as (select flight_id, track_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from tr), d as (select *, sqrt(power(cx - avg(cx) over w, 2) + power(cy - avg(cy) over w, 2)) as d from c window w as (partition by flight_id, track_id))
select flight_id, track_id, count(*) as n, count(*) filter (d > 30) as outliers, round(max(d), 4) as max_distance, round(stddev_pop(d), 4) as std_distance, (count(*) filter (d > 30) >= 20 or count(*) filter (d > 30) * 1.0 / count(*) >= 0.5) as moved from d group by 1, 2 having count(*) >= 2""")
def track_movement(spark, sf):
    return tracks.movement(_tracks(spark, sf), 30.0, 20, 0.5).select("flight_id", "track_id", "n", "outliers", *r4("max_distance", "std_distance"), "moved")


def _modalities(spark, sf):
    d = plans.detections(spark, sf).select("frame", "track_id", F.col("x1").alias("cx"), F.col("y1").alias("cy"), "confidence", "row_id")
    return d.where("row_id % 2 = 0").withColumn("track_id", F.col("track_id") % 40), d.where("row_id % 2 = 1").withColumn("track_id", F.col("track_id") % 30)


_MOD = "ma as (select frame, track_id % 40 as track_id, x1 as cx, y1 as cy, confidence from det where row_id % 2 = 0), mb as (select frame, track_id % 30 as track_id, x1 as cx, y1 as cy, confidence from det where row_id % 2 = 1)"
_CANDS = f"{_MOD}, j as (select a.track_id as track_t, b.track_id as track_w, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) as d from ma a join mb b on a.frame = b.frame), c as (select track_t, track_w, count(*) as shared, median(d) as median_dist from j group by all)"


@query(f"""with {_CANDS} select track_t, track_w, shared, round(median_dist, 4) as median_dist, round((select avg(confidence) from ma where track_id = track_t), 4) as conf_t,
  case when shared < 8 then 'shared' when median_dist >= 28 then 'distance' end as rejected from c""")
def match_candidates(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracks.gate(tracks.candidates(a, b, pairs)).select("track_t", "track_w", "shared", *r4("median_dist", "conf_t"), "rejected")


@query(f"""with {_CANDS} select rejected, count(*) as n from (select case when shared < 8 then 'shared' when median_dist >= 28 then 'distance' else 'accepted' end as rejected from c) group by 1""")
def rejection_reasons(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracks.gate(tracks.candidates(a, b, pairs)).groupBy(F.coalesce("rejected", F.lit("accepted")).alias("rejected")).agg(F.count("*").alias("n"))


@query(f"""with {_MOD}, a1 as (select frame, min(cx) as ax, min(cy) as ay from ma group by 1 having count(*) = 1), b1 as (select frame, min(cx) as bx, min(cy) as bya from mb group by 1 having count(*) = 1)
select frame as frame_a, ax, ay, bx, bya as "by" from a1 join b1 using (frame)""")
def seeds(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracks.seed_pairs(a, b, pairs).select("frame_a", "ax", "ay", "bx", "by")


@query(f"""with {_MOD}, a1 as (select frame, min(cx) as ax, min(cy) as ay from ma group by 1 having count(*) = 1), b1 as (select frame, min(cx) as bx, min(cy) as bya from mb group by 1 having count(*) = 1)
select count(*) as n, sum(ax) as sx, sum(ay) as sy, sum(ax * ax) as sxx, sum(ax * ay) as sxy, sum(ay * ay) as syy, sum(bx) as bx1, sum(bx * ax) as bxx, sum(bx * ay) as bxy, sum(bya) as by1, sum(bya * ax) as byx, sum(bya * ay) as byy from a1 join b1 using (frame)""")
def affine_normal_sums(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracks.affine_sums(tracks.seed_pairs(a, b, pairs))


@query()
def matched_tracks(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracking.match_tracks(a, b, pairs, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), shared=3)


# Two animals that cross nine frames, a third box at the end, and a pair of boxes of two classes.
# Animals 100 m apart that shake by less than a metre: a tracker can only tell them apart right, so SQL can state its numbers.
_LANES = """lane as (select track_id % 20 as flight_id, track_id, frame, row_id, class_id from (select *, row_number() over (partition by track_id, frame, class_id order by row_id) as k from det) where k = 1),
  w as (select *, dense_rank() over (partition by flight_id order by frame) as f from lane), g as (select *, f - row_number() over (partition by track_id, class_id order by f) as run from w)"""


@query(f"""with {_LANES}, first as (select *, min((frame, row_id)) over (partition by track_id, class_id) as a, min((frame, row_id)) over (partition by track_id, class_id, run) as b from g)
select row_id, dense_rank() over (partition by flight_id order by a) as forever, dense_rank() over (partition by flight_id order by b) as at_once from first""")
def tracker_scene(spark, sf):
    """Numbers of tracks that are known: of tracks that stay open, and of tracks that close at once where missed. Boxes of two classes stand on one place and are kept apart."""
    d = plans.detections(spark, sf)
    k = F.row_number().over(Window.partitionBy("track_id", "frame", "class_id").orderBy("row_id"))
    x, y = F.col("track_id") * 100.0 + F.col("row_id") % 7 * 0.1, F.col("row_id") % 5 * 0.1
    d = d.withColumn("k", k).where("k = 1").select((F.col("track_id") % 20).alias("flight_id"), "frame", "row_id", x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 8).alias("y2"), "class_id")
    one = lambda name, **how: tracking.track_boxes(d, least=0.3, **how).select("row_id", F.col("track_id").alias(name))
    return one("forever", mode="greedy").join(one("at_once", mode="hungarian", max_age=0), "row_id")


@query()
def tracker_greedy(spark, sf):
    return tracking.track_boxes(_tracks(spark, sf), mode="greedy", least=0.1, max_age=3)


@query()
def tracker_motion(spark, sf):
    """A motion model and two rounds of matching; null for boxes of no track."""
    return motion.track_by_motion(plans.detections(spark, sf).withColumn("flight_id", F.col("track_id") % 20), sure=0.8, new=0.8, patience=40)


@query()
def tracker_hungarian(spark, sf):
    return tracking.track_boxes(_tracks(spark, sf), mode="hungarian_center", least=0.1, max_age=3)


_SIMPLE = """with rec(flight_id, a, b, xa, ya, xb, yb) as (
  select m.flight_id, a, b, p.x, p.y, q.x, q.y from (select flight_id, min(frame) as a, max(frame) as b from route group by 1) m join route p on p.flight_id = m.flight_id and p.frame = a join route q on q.flight_id = m.flight_id and q.frame = b
  union all
  select n.flight_id, case when side = 0 then n.a else n.k end, case when side = 0 then n.k else n.b end, case when side = 0 then n.xa else p.x end, case when side = 0 then n.ya else p.y end, case when side = 0 then p.x else n.xb end, case when side = 0 then p.y else n.yb end
  from (select rec.*, (select arg_max(r.frame, case when xa = xb and ya = yb then sqrt(power(r.x - xa, 2) + power(r.y - ya, 2)) else abs((xb - xa) * (r.y - ya) - (yb - ya) * (r.x - xa)) / sqrt(power(xb - xa, 2) + power(yb - ya, 2)) end) from route r where r.flight_id = rec.flight_id and r.frame > rec.a and r.frame < rec.b) as k,
    (select max(case when xa = xb and ya = yb then sqrt(power(r.x - xa, 2) + power(r.y - ya, 2)) else abs((xb - xa) * (r.y - ya) - (yb - ya) * (r.x - xa)) / sqrt(power(xb - xa, 2) + power(yb - ya, 2)) end) from route r where r.flight_id = rec.flight_id and r.frame > rec.a and r.frame < rec.b) as d from rec where rec.b > rec.a + 1) n
  join route p on p.flight_id = n.flight_id and p.frame = n.k, (values (0), (1)) t(side) where n.d > 500)
select distinct r.flight_id, r.frame, r.x, r.y from route r join rec on r.flight_id = rec.flight_id and r.frame in (rec.a, rec.b)"""


@query(_SIMPLE)
def simplified_routes(spark, sf):
    return tracking.simplify(plans.routes(spark, sf), 500.0, ("flight_id",))


@query(_SIMPLE)
def simplified_long_routes(spark, sf):
    """The same routes, level by level: no task holds more than 100 points of a stretch."""
    return simplification.simplify_long(plans.routes(spark, sf), 500.0, ("flight_id",), small=100)


@query(f"""with {_TR}, pc as (select flight_id, track_id * 1000000 + frame // 100 * 2 + case when frame % 100 >= 80 then 1 else 0 end as track_id, frame, row_id, x1, y1, x2, y2 from tr),
  n as (select flight_id, track_id, count(distinct frame) as n, min(frame) as f1, max(frame) as f2 from pc group by all),
  en as (select n.*, arg_min(struct_pack(x1, y1, x2, y2), pc.frame * 1000000000 + row_id) as a, arg_max(struct_pack(x1, y1, x2, y2), pc.frame * 1000000000 + row_id) as z from n join pc using (flight_id, track_id) group by all),
  j as (select s.flight_id, s.track_id as short, l.track_id as long, l.f1 - s.f2 - 1 as gap, s.z as p, l.a as q from en s join en l on s.flight_id = l.flight_id and s.n < 4 and l.n >= 4 and l.f1 - s.f2 between 1 and 31
    union all select s.flight_id, s.track_id, l.track_id, s.f1 - l.f2 - 1, l.z, s.a from en s join en l on s.flight_id = l.flight_id and s.n < 4 and l.n >= 4 and s.f1 - l.f2 between 1 and 31),
  m as (select *, greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0) as both_area, (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) as areas,
    sqrt(power((p.x1 + p.x2 - q.x1 - q.x2) / 2, 2) + power((p.y1 + p.y2 - q.y1 - q.y2) / 2, 2)) / greatest(1e-9, (sqrt(power(p.x2 - p.x1, 2) + power(p.y2 - p.y1, 2)) + sqrt(power(q.x2 - q.x1, 2) + power(q.y2 - q.y1, 2))) / 2) as near from j),
  i as (select *, (both_area / (areas - both_area))::float as iou from m),
  o as (select * from i where (iou >= 0.1 or near <= 2.0) and not exists (select 1 from pc x join pc y on x.flight_id = y.flight_id and x.frame = y.frame where x.flight_id = i.flight_id and x.track_id = i.short and y.track_id = i.long)),
  k as (select *, row_number() over (partition by flight_id, short order by round(1 - iou + near, 6), gap, long) as k from o)
select flight_id, short, long, gap from k where k = 1""")
def stitched_fragments(spark, sf):
    """Tracks cut at every 80th and 100th frame, and which of the short pieces join which long ones."""
    piece = F.floor(F.col("frame") / 100) * 2 + (F.col("frame") % 100 >= 80).cast("long")
    return tracks.fragments(_tracks(spark, sf).withColumn("track_id", F.col("track_id") * 1000000 + piece), 4, 30, 0.1, 2.0)


@query("""select flight_id, transect_id, count(*) as n from (select flight_id, frame // 10 as transect_id from tele) group by all""")
def transect_counts(spark, sf):
    t = plans.telemetry(spark, sf).withColumn("transect_id", F.floor(F.col("frame") / 10))
    dim = t.select("flight_id", "transect_id").distinct()
    return estimators.counts(t, dim).withColumnRenamed("count", "n")


_STRATA = "strata as (select o_custkey % 5 as stratum, count(*) as \"count\", 10 + (o_custkey % 37) * 1.5 as area_ha from orders group by o_custkey)"


def _strata(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("count")).select((F.col("o_custkey") % 5).alias("stratum"), "count", (10 + (F.col("o_custkey") % 37) * 1.5).alias("area_ha"))


@query(f"""with {_STRATA} select stratum, round(sum("count") / sum(area_ha) * 100, 4) as density, count(*) as n from strata group by 1""")
def survey_density(spark, sf):
    return estimators.naive(_strata(spark, sf)).select("stratum", F.round("density", 4).alias("density"), "n")


@query()
def bootstrap_density(spark, sf):
    return estimators.bootstrap(_strata(spark, sf))


@query()
def zero_inflated_density(spark, sf):
    return estimators.zinb(_strata(spark, sf).withColumn("count", F.greatest(F.col("count") - 8, F.lit(0))))


@query()
def distance_sampling(spark, sf):
    d = plans.detections(spark, sf).select((F.col("frame") % 3).alias("stratum"), F.abs(F.col("x1") + F.col("y1") - 75).alias("distance"), F.lit(1000.0).alias("effort_m"))
    return estimators.distance_density(d)


@query("""select frame % 3 as stratum, round(quantile_cont(abs(x1 + y1 - 75), 0.95), 4) as w, count(*) as n from det group by 1""")
def truncation_distance(spark, sf):
    d = plans.detections(spark, sf).select((F.col("frame") % 3).alias("stratum"), F.abs(F.col("x1") + F.col("y1") - 75).alias("distance"))
    return d.groupBy("stratum").agg(F.round(F.percentile("distance", F.lit(0.95)), 4).alias("w"), F.count("*").alias("n"))


@query("""select flight_id, count(*) filter (lat between 48.02 and 48.08 and lon between 14.01 and 14.06) as inside, count(*) as n, round(min(lat), 6) as min_lat, round(max(lon), 6) as max_lon from tele group by 1""")
def coverage_check(spark, sf):
    ok = F.col("lat").between(48.02, 48.08) & F.col("lon").between(14.01, 14.06)
    return plans.telemetry(spark, sf).where(geodesy.valid_position(F.col("lat"), F.col("lon"))).groupBy("flight_id").agg(F.sum(ok.cast("long")).alias("inside"), F.count("*").alias("n"), F.round(F.min("lat"), 6).alias("min_lat"), F.round(F.max("lon"), 6).alias("max_lon"))


@query("""select flight_id, count(distinct track_id) as tracks, round(avg(confidence), 4) as confidence, round(min(x1) - 10, 4) as min_x, round(max(y2) + 10, 4) as max_y from det group by 1""")
def flight_summary(spark, sf):
    return plans.detections(spark, sf).groupBy("flight_id").agg(F.count_distinct("track_id").alias("tracks"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.min("x1") - 10, 4).alias("min_x"), F.round(F.max("y2") + 10, 4).alias("max_y"))


# ------------------------------------------------------------------- rasters


@query("""select (49 - y1)::bigint as "row", x1::bigint as col, count(*) as n from det group by all""")
def binned_cells(spark, sf):
    p = plans.detections(spark, sf).select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return rasters.binned(p, {"min_x": 0.0, "max_y": 49.999, "cell": 1.0, "width": 100, "height": 50})


_KDE = """e as (select min(x1) - 30 as x0, min(y1) - 30 as y0, greatest(1, ceil((max(x1) - min(x1) + 60) / 5))::bigint as w, greatest(1, ceil((max(y1) - min(y1) + 60) / 5))::bigint as h from det),
  n as (select floor((y0 + 5 * h - y1) / 5)::bigint as r, floor((x1 - x0) / 5)::bigint as c, count(*) * 1.0e0 as n from det, e group by all),
  k as (select i, exp(-0.5e0 * i * i / 4) / (select sum(exp(-0.5e0 * j * j / 4)) from range(-8, 9) t(j)) as k from range(-8, 9) t(i))"""


@query(f"""with {_KDE} select r + a.i as "row", c + b.i as col, round(sum(n * a.k * b.k) * 400, 3) as density from n, k a, k b, e where r + a.i between 0 and h - 1 and c + b.i between 0 and w - 1 group by all""")
def density_surface(spark, sf):
    p = plans.detections(spark, sf).select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return rasters.density(p, 5.0, 10.0).select("row", "col", F.round("density", 3).alias("density"))


@query("""with b as (select x1 + 0.25 as x1, y1 + 0.25 as y1, x1 + 0.25 + 1 + (row_id % 3) as x2, y1 + 0.25 + 1 + (row_id % 2) as y2 from det), o as (select min(x1) as x0, max(y2) as y0 from b),
  k as (select *, unnest(range(floor(x1 - x0)::bigint, floor(x2 - x0)::bigint + 1)) as col from b, o), r as (select *, unnest(range(floor(y0 - y2)::bigint, floor(y0 - y1)::bigint + 1)) as "row" from k)
select "row", col, count(*) as n from r where x0 + (col + 0.5) between x1 and x2 and y0 - ("row" + 0.5) between y1 and y2 group by all""")
def coverage_cells(spark, sf):
    b = plans.detections(spark, sf).selectExpr("x1 + 0.25 as x1", "y1 + 0.25 as y1", "x1 + 0.25 + 1 + (row_id % 3) as x2", "y1 + 0.25 + 1 + (row_id % 2) as y2")
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    return rasters.coverage(b.select(ring.alias("ring")))


_LAYERS = "layers as (select y1::bigint as \"row\", x1::bigint as col, row_id as shot, l as value, abs(x1 - 50) + row_id % 5 as distance from (select *, (row_id % 97) * 1.0e0 as l from det))"


def _layers(spark, sf):
    return plans.detections(spark, sf).select(F.col("y1").cast("long").alias("row"), F.col("x1").cast("long").alias("col"), F.col("row_id").alias("shot"), (F.col("row_id") % 97).cast("double").alias("value"), (F.abs(F.col("x1") - 50) + F.col("row_id") % 5).alias("distance"))


@query(f"""with {_LAYERS} select "row", col, round_even(avg(value), 0) as value, count(*) as layers from layers group by all""")
def mosaic_average(spark, sf):
    return rasters.mosaic(_layers(spark, sf))


@query(f"""with {_LAYERS} select "row", col, arg_min(value, shot) as first_value, arg_max(value, shot) as last_value, arg_min(value, distance * 100000000 + shot) as center_value from layers group by all""")
def mosaic_blends(spark, sf):
    m = _layers(spark, sf)
    one = lambda how: rasters.mosaic(m, how).select("row", "col", F.col("value").alias(f"{how}_value"))
    return one("first").join(one("last"), ["row", "col"]).join(one("center"), ["row", "col"])


@query(f"""with {_LAYERS}, v as (select distinct "row", col from layers) select "row", col from v a where (select count(*) from v b where abs(a."row" - b."row") + abs(a.col - b.col) = 1) = 4""")
def eroded_mask(spark, sf):
    return rasters.eroded(_layers(spark, sf).select("row", "col").distinct(), 1)


@query(f"""with {_LAYERS}, v as (select distinct "row", col from layers where col > 20 and "row" > 7) select "row" - min("row") over () as "row", col - min(col) over () as col from v""")
def cropped_cells(spark, sf):
    return rasters.cropped(_layers(spark, sf).select("row", "col").distinct().where("col > 20 and row > 7"))


_PICTURES = """pic as (select flight_id, count(*) as n, 800 + count(*) % 700 as w, 500 + flight_id * 37 % 400 as h from tele group by 1),
  c as (select *, unnest(range(ceil(w / 300)::bigint)) as c from pic), t as (select *, unnest(range(ceil(h / 300)::bigint)) as r from c),
  tile as (select flight_id, n, w as width, h as height, r * ceil(w / 300)::bigint + c as tile, c * 300 as x, r * 300 as y, least(428, w - c * 300) as w, least(428, h - r * 300) as h from t)"""


def _picture_tiles(spark, sf):
    pictures = plans.telemetry(spark, sf).groupBy("flight_id").agg(F.count("*").alias("n")).select("flight_id", "n", (800 + F.col("n") % 700).alias("width"), (500 + F.col("flight_id") * 37 % 400).alias("height"))
    return rasters.picture_tiles(pictures, 428, 128)


@query(f"""with {_PICTURES} select flight_id, tile, x, y, w, h from tile""")
def overlapping_tiles(spark, sf):
    """Tiles of a picture of each flight."""
    return _picture_tiles(spark, sf).select("flight_id", "tile", "x", "y", "w", "h")


_HEIGHTS = "h as (select y1::bigint as \"row\", x1::bigint as col, max((row_id % 50) * 1.0e0) as z from det group by all)"


def _heights(spark, sf):
    return plans.detections(spark, sf).groupBy(F.col("y1").cast("long").alias("row"), F.col("x1").cast("long").alias("col")).agg(F.max(F.col("row_id") % 50 * 1.0).alias("z"))


@query(f"""with {_HEIGHTS}, p as (select row_id, x1 + 0.3 as px, y1 + (row_id % 9) * 0.1 as py from det),
  q as (select p.*, px - floor(px) as tx, py - floor(py) as ty, a.z as z0, b.z as z1, c.z as z2, d.z as z3 from p left join h a on a."row" = floor(py) and a.col = floor(px) left join h b on b."row" = floor(py) and b.col = floor(px) + 1 left join h c on c."row" = floor(py) + 1 and c.col = floor(px) left join h d on d."row" = floor(py) + 1 and d.col = floor(px) + 1)
select row_id, round(case when tx + ty <= 1 then z0 + tx * (z1 - z0) + ty * (z2 - z0) else z3 + (1 - tx) * (z2 - z3) + (1 - ty) * (z1 - z3) end, 4) as z from q""")
def sampled_heights(spark, sf):
    p = plans.detections(spark, sf).selectExpr("row_id", "x1 + 0.3 as px", "y1 + (row_id % 9) * 0.1 as py")
    return rasters.sampled(_heights(spark, sf), p, 1.0).select("row_id", F.round("z", 4).alias("z"))


@query(f"""with {_HEIGHTS}, i as (select "row" * 100 + col as i from h where "row" < 49 and col < 99) select i as a, i + 100 as b, i + 1 as c from i union all select i + 1, i + 100, i + 101 from i""")
def terrain_mesh(spark, sf):
    return rasters.heightfield_mesh(_heights(spark, sf), 100, 50, 1.0)[1]


@query(f"""with {_HEIGHTS} select "row" * 100 + col as v, col * 1.0e0 as x, (49 - "row") * 1.0e0 as y, z from h""")
def terrain_vertices(spark, sf):
    return rasters.heightfield_mesh(_heights(spark, sf), 100, 50, 1.0)[0]


@query("""with k as (select *, unnest(range(floor(x1 / 0.5)::bigint, floor(x2 / 0.5)::bigint + 1)) as c from det), r as (select *, unnest(range(floor(y1 / 0.5)::bigint, floor(y2 / 0.5)::bigint + 1)) as r from k)
select flight_id, round(count(*) * 0.25e0, 4) as area from (select distinct flight_id, c, r from r where (c + 0.5) * 0.5 between x1 and x2 and (r + 0.5) * 0.5 between y1 and y2) group by 1""")
def union_areas(spark, sf):
    d = plans.detections(spark, sf).withColumn("ring", F.slice(boxes.ring(boxes.box()), 1, 4))
    return rasters.union_area(d, "flight_id", 0.5).select("flight_id", F.round("area", 4).alias("area"))


# ------------------------------------------------------------ clocks and ground


def _clock(spark, sf):
    return plans.telemetry(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("""with r as (select flight_id, id, epoch(ts) as t from tele), a as (select distinct flight_id, epoch(timestamp '2024-01-10 00:00:00') as asked from tele),
  j as (select a.flight_id, id, row_number() over (partition by a.flight_id order by abs(t - asked), t, id) as k from a join r on r.flight_id = a.flight_id and abs(t - asked) <= 43200)
select flight_id, id from j where k = 1""")
def nearest_log_row(spark, sf):
    t = _clock(spark, sf)
    at = t.select("flight_id").distinct().withColumn("at", F.lit(1704844800.0))
    return clocks.nearest_row(t.select("flight_id", "id", "t"), at, 43200.0).select("flight_id", "id")


@query("""with r as (select flight_id, frame, epoch(ts) as t from tele) select flight_id, k::int as range_id, min(frame) as start_frame, max(frame) as end_frame from r, range(4) x(k) where t between 1704067200 + k * 604800 and 1704067200 + k * 604800 + 300000 group by 1, 2""")
def ranges_of_times(spark, sf):
    t = _clock(spark, sf)
    r = t.select("flight_id").distinct().withColumn("range_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("low", 1704067200.0 + F.col("range_id") * 604800).withColumn("high", F.col("low") + 300000)
    return clocks.index_ranges(t, r)


@query("""with r as (select flight_id, epoch(ts) as t, alt as v, row_number() over w as i, count(*) over (partition by flight_id) as n, lead(epoch(ts)) over w as t2, lead(alt) over w as v2 from tele window w as (partition by flight_id order by ts)),
  a as (select distinct flight_id, 1704067200 + k * 1000000.0 as asked from tele, range(4) x(k))
select a.flight_id, asked::bigint as asked, round(v + (v2 - v) * (asked - t) / (t2 - t), 2) as alt from a join r on r.flight_id = a.flight_id and t2 is not null and (asked >= t or i = 1) and (asked < t2 or i = n - 1)""")
def values_at_times(spark, sf):
    t = _clock(spark, sf)
    a = t.select("flight_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(1704067200 + k * 1000000.0) for k in range(4)])))
    return clocks.at_times(t, a, "alt").select("flight_id", F.col("at").cast("long").alias("asked"), F.round("alt", 2).alias("alt"))


@query()
def unique_photo_matches(spark, sf):
    t = _clock(spark, sf)
    return clocks.unique_matches(t.where("id % 2 = 0").select("flight_id", F.col("id").alias("photo_id"), "t"), t.where("id % 2 = 1").select("flight_id", F.col("id").alias("log_id"), "t"), 21600.0)


@query()
def clock_offsets(spark, sf):
    t = _clock(spark, sf).withColumn("t", F.col("frame").cast("double"))
    return clocks.clock_offset(t.withColumn("t", F.col("t") - 0.3), t)


@query("""with f as (select flight_id % 4 as file_no, id, frame * 100 as start_ms, frame * 100 + 90 as end_ms from tele), e as (select file_no, max(end_ms) as e, count(*) as n from f group by 1),
  b as (select file_no, coalesce(sum(e) over w, 0) as base, coalesce(sum(n) over w, 0) as first from e window w as (order by file_no rows between unbounded preceding and 1 preceding))
select f.file_no, (first + row_number() over (partition by f.file_no order by start_ms, f.id) - 1)::bigint as id, (start_ms + base)::bigint as start_ms, (end_ms + base)::bigint as end_ms from f join b using (file_no)""")
def merged_subtitles(spark, sf):
    t = plans.telemetry(spark, sf)
    return paths.concatenated(t.select((F.col("flight_id") % 4).alias("file_no"), "id", (F.col("frame") * 100).alias("start_ms"), (F.col("frame") * 100 + 90).alias("end_ms"))).select("file_no", "id", "start_ms", "end_ms")


_CAST = """p as (select flight_id, frame, (lat - 48) * 111320.0e0 as east, (lon - 14) * 74500.0e0 as north, 30 + alt as up, radians(frame % 40) as t, radians(frame * 17 % 360) as h, radians(roll) as w, tan(radians(25)) as k from tele),
  o as (select p.*, {cols}, (2 * px / 512 - 1) * k as a0, (1 - 2 * py / 512) * k as c0 from {rows}),
  q as (select *, a0 * cos(w) + c0 * sin(w) as a, c0 * cos(w) - a0 * sin(w) as c from o),
  r as (select *, sin(t) * sin(h) + a * cos(h) + c * cos(t) * sin(h) as d0, sin(t) * cos(h) - a * sin(h) + c * cos(t) * cos(h) as d1, -cos(t) + c * sin(t) as d2 from q),
  g as (select *, case when d2 < 0 then east - up / d2 * d0 end as gx, case when d2 < 0 then north - up / d2 * d1 end as gy from r)"""


def _tilted(spark, sf):
    return plans.telemetry(spark, sf).selectExpr("flight_id", "frame", "(lat - 48) * 111320.0D as east", "(lon - 14) * 74500.0D as north", "30 + alt as up", "cast(frame % 40 as double) as tilt", "cast(frame * 17 % 360 as double) as heading", "roll")


@query(f"""with b as (select flight_id, frame, row_id, unnest([x1, x2, x2, x1]) as px, unnest([y1, y1, y2, y2]) as py from det), {_CAST.format(cols="b.row_id, b.px, b.py", rows="b left join p using (flight_id, frame)").replace("select p.*, b.row_id", "select b.flight_id, b.frame, east, north, up, t, h, w, k, b.row_id")}
select flight_id, frame, row_id, round(min(gx), 3) as min_x, round(min(gy), 3) as min_y, round(max(gx), 3) as max_x, round(max(gy), 3) as max_y from g group by 1, 2, 3""")
def boxes_on_ground(spark, sf):
    b = plans.detections(spark, sf)
    return terrain.boxes_to_ground(b, _tilted(spark, sf), 50.0, 512.0, 512.0).select("flight_id", "frame", "row_id", *[F.round(c, 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(f"""with e as (select unnest([0, 511, 511, 0]) as px, unnest([0, 0, 511, 511]) as py, unnest([1, 2, 3, 4]) as corner), {_CAST.format(cols="px, py, corner", rows="p, e")}
select flight_id, frame, round(max(gx) filter (corner = 1), 3) as x1, round(max(gy) filter (corner = 1), 3) as y1, round(max(gx) filter (corner = 3), 3) as x3, round(max(gy) filter (corner = 3), 3) as y3, count(gx) as corners from g group by 1, 2""")
def frame_footprints(spark, sf):
    ring = terrain.footprints(_tilted(spark, sf), 50.0, 512.0, 512.0).where(F.size("ring") == 4)
    at = lambda k, c: F.round(F.col("ring")[k][c], 3)
    return ring.select("flight_id", "frame", at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(2, "x").alias("x3"), at(2, "y").alias("y3"), F.size("ring").cast("long").alias("corners"))


_RAYS = """(select row_id, x1 + 0.3 as ox, 49 - (y1 + 0.05 + (row_id % 9) * 0.1) as oy, 60.0e0 as oz, radians(row_id % 25) as t, radians(row_id * 17 % 360) as h, radians(row_id % 13 - 6) as w,
    (2 * (40 + row_id * 7 % 430) / 512.0e0 - 1) * tan(radians(25)) as a, (1 - 2 * (60 + row_id * 11 % 390) / 512.0e0) * tan(radians(25)) as c from det)"""


@query(f"""with {_HEIGHTS}, turned as (select *, a * cos(w) + c * sin(w) as a2, c * cos(w) - a * sin(w) as c2 from {_RAYS}),
  d as (select *, sin(t) * sin(h) + a2 * cos(h) + c2 * cos(t) * sin(h) as dx, sin(t) * cos(h) - a2 * sin(h) + c2 * cos(t) * cos(h) as dy, -cos(t) + c2 * sin(t) as dz from turned),
  e as (select d.*, (hi - oz) / dz as s0, (lo - oz) / dz as s1 from d, (select max(z) as hi, min(z) as lo from h)),
  x as (select *, unnest(range(floor(least(ox + s0 * dx, ox + s1 * dx))::bigint, floor(greatest(ox + s0 * dx, ox + s1 * dx))::bigint + 1)) as col from e),
  y as (select *, unnest(range(floor(least(49 - oy - s0 * dy, 49 - oy - s1 * dy))::bigint, floor(greatest(49 - oy - s0 * dy, 49 - oy - s1 * dy))::bigint + 1)) as "row" from x),
  q as (select y.*, unnest([{{'x': y.col, 'y': 49 - y."row", 'z': p0.z, 'e': 1, 'ez': p1.z - p0.z, 'f': -1, 'fz': p2.z - p0.z}}, {{'x': y.col + 1, 'y': 48 - y."row", 'z': p3.z, 'e': -1, 'ez': p2.z - p3.z, 'f': 1, 'fz': p1.z - p3.z}}]) as v
    from y left join h p0 on p0."row" = y."row" and p0.col = y.col left join h p1 on p1."row" = y."row" and p1.col = y.col + 1 left join h p2 on p2."row" = y."row" + 1 and p2.col = y.col left join h p3 on p3."row" = y."row" + 1 and p3.col = y.col + 1),
  m as (select row_id, ox, oy, oz, dx, dy, dz, v.e as ex, v.ez as ez, v.f as fy, v.fz as fz, dy * v.fz - dz * v.f as p1, -dx * v.fz as p2, dx * v.f as p3, ox - v.x as tx, oy - v.y as ty, oz - v.z as tz from q),
  k as (select *, ex * p1 + ez * p3 as det, tx * p1 + ty * p2 + tz * p3 as u, ty * ez as q1, tz * ex - tx * ez as q2, -ty * ex as q3 from m),
  i as (select row_id, ox, oy, oz, dx, dy, dz, u / det as u, (dx * q1 + dy * q2 + dz * q3) / det as v, (fy * q2 + fz * q3) / det as s from k where det <> 0),
  n as (select row_id, min(s) as s, any_value(ox) as ox, any_value(oy) as oy, any_value(oz) as oz, any_value(dx) as dx, any_value(dy) as dy, any_value(dz) as dz from i where s >= 0 and u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9 group by row_id)
select d.row_id, round(n.ox + n.s * n.dx, 4) as gx, round(n.oy + n.s * n.dy, 4) as gy, round(n.oz + n.s * n.dz, 4) as gz from det d left join n using (row_id)""")
def terrain_hits(spark, sf):
    """Where rays of tilted and rolled cameras first meet a rugged heightfield; the SQL meets each triangle under a ray by edges and cross products."""
    d = plans.detections(spark, sf).selectExpr(
        "row_id", "cast(40 + row_id * 7 % 430 as double) as px", "cast(60 + row_id * 11 % 390 as double) as py", "x1 + 0.3 as east", "49 - (y1 + 0.05 + (row_id % 9) * 0.1) as north", "60.0D as up",
        "cast(row_id % 25 as double) as tilt", "cast(row_id * 17 % 360 as double) as heading", "cast(row_id % 13 - 6 as double) as roll",
    )
    return terrain.pixels_to_heights(d, _heights(spark, sf), 50, 1.0, 50.0, 512.0, 512.0).select("row_id", *r4("gx", "gy", "gz"))


_SLOPE_POSES = """p as (select distinct flight_id, frame, 20.0e0 + frame % 80 as ox, 15.0e0 + frame * 7 % 70 as oy, 40.0e0 as oz, radians(frame % 35) as t, radians(frame * 17 % 360) as h, radians(frame % 11 - 5) as w from det)"""
_SLOPE_HITS = """k as (select *, (2 * px / 512 - 1) * tan(radians(25)) as a0, (1 - 2 * py / 512) * tan(radians(25)) as c0 from r), d as (select *, a0 * cos(w) + c0 * sin(w) as a, c0 * cos(w) - a0 * sin(w) as c from k),
  e as (select *, sin(t) * sin(h) + a * cos(h) + c * cos(t) * sin(h) as dx, sin(t) * cos(h) - a * sin(h) + c * cos(t) * cos(h) as dy, -cos(t) + c * sin(t) as dz from d), s as (select *, (0.2e0 * ox + 0.1e0 * oy - 7 - oz) / (dz - 0.2e0 * dx - 0.1e0 * dy) as s from e),
  g as (select *, s >= 0 and ox + s * dx between 0 and 120 and oy + s * dy between 0 and 120 as hit from s)"""


def _slope(spark):
    """A slope of 31 x 31 points, 4 m apart."""
    return spark.range(961).select(F.floor(F.col("id") / 31).alias("row"), (F.col("id") % 31).alias("col")).withColumn("z", 0.8 * F.col("col") + 0.4 * (30 - F.col("row")) - 7)


def _slope_poses(spark, sf):
    return plans.detections(spark, sf).select("flight_id", "frame").distinct().selectExpr("flight_id", "frame", "20.0D + frame % 80 as east", "15.0D + frame * 7 % 70 as north", "40.0D as up", "cast(frame % 35 as double) as tilt", "cast(frame * 17 % 360 as double) as heading", "cast(frame % 11 - 5 as double) as roll")


@query(f"""with {_SLOPE_POSES}, b as (select flight_id, frame, row_id, unnest([{{'i': 0, 'x': x1, 'y': y1}}, {{'i': 1, 'x': x2, 'y': y1}}, {{'i': 2, 'x': x2 * 2, 'y': y2 * 3}}, {{'i': 3, 'x': x1, 'y': y2}}]) as spot from det),
  r as (select b.row_id, spot.i as corner, p.*, spot.x * 3 as px, spot.y * 3 as py from b join p using (flight_id, frame)), {_SLOPE_HITS}
select row_id, corner, case when hit then round(ox + s * dx, 3) end as x, case when hit then round(oy + s * dy, 3) end as y, case when hit then round(oz + s * dz, 3) end as z from g""")
def polygons_on_terrain(spark, sf):
    """Corners of polygons on a slope, in order, null where their rays pass the field."""
    at = lambda x, y: F.struct((x * 3).alias("x"), (y * 3).alias("y"))
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    d = plans.detections(spark, sf).select("flight_id", "frame", "row_id", F.array(at(x1, y1), at(x2, y1), at(x2 * 2, y2 * 3), at(x1, y2)).alias("ring"))
    out = terrain.rings_to_heights(d, _slope_poses(spark, sf), _slope(spark), 31, 4.0, 50.0, 512.0, 512.0)
    return out.select("row_id", F.posexplode("ground_ring").alias("corner", "p")).select("row_id", "corner", *[F.round(F.col(f"p.{c}"), 3).alias(c) for c in "xyz"])


@query(f"""with {_SLOPE_POSES}, r as (select * from p, (select unnest([0, 1, 2, 3]) as corner, unnest([0, 511, 511, 0]) as px, unnest([0, 0, 511, 511]) as py)), {_SLOPE_HITS}
select flight_id, frame, corner, case when hit then round(ox + s * dx, 3) end as x, case when hit then round(oy + s * dy, 3) end as y from g""")
def footprints_on_terrain(spark, sf):
    out = terrain.footprints_on_heights(_slope_poses(spark, sf), _slope(spark), 31, 4.0, 50.0, 512.0, 512.0)
    return out.select("flight_id", "frame", F.posexplode("ground_ring").alias("corner", "p")).select("flight_id", "frame", "corner", *[F.round(F.col(f"p.{c}"), 3).alias(c) for c in "xy"])


def _corner(i: int) -> str:
    """Corner i of a square of the terrain in the axes of a camera."""
    x, y, z = f"(col + {i % 2} - ox)", f'(49 - "row" - {i // 2} - oy)', f"(z{i} - oz)"
    return ", ".join(f"{x} * {n}0 + {y} * {n}1 + {z} * {n}2 as {n}{n}{i}" for n in "fru")


_SHOTS = f"""hills as (select "row", col, z * 0.1e0 as z from h), p as (select flight_id, frame, id, 3 + id * 37 % 9400 / 100.0e0 as ox, 3 + id * 53 % 4400 / 100.0e0 as oy, 15.3e0 + id % 7 as oz, radians(id % 30 + 0.37e0) as t, radians(id * 17 % 360 + 0.21e0) as h, radians(roll + 0.13e0) as w, tan(radians(15)) as k from tele),
  b as (select *, sin(t) * sin(h) as f0, sin(t) * cos(h) as f1, -cos(t) as f2, cos(w) * cos(h) - sin(w) * cos(t) * sin(h) as r0, -cos(w) * sin(h) - sin(w) * cos(t) * cos(h) as r1, -sin(w) * sin(t) as r2,
    sin(w) * cos(h) + cos(w) * cos(t) * sin(h) as u0, -sin(w) * sin(h) + cos(w) * cos(t) * cos(h) as u1, cos(w) * sin(t) as u2 from p),
  o as (select b.*, hills."row", hills.col, hills.col - ox as dx, 49 - hills."row" - oy as dy, hills.z - oz as dz from b, hills),
  seen as (select *, dx * f0 + dy * f1 + dz * f2 as d, ((dx * r0 + dy * r1 + dz * r2) / ((dx * f0 + dy * f1 + dz * f2) * k) + 1) * 8 as px, 16 - ((dx * u0 + dy * u1 + dz * u2) / ((dx * f0 + dy * f1 + dz * f2) * k) + 1) * 8 as py from o),
  square as (select "row" - i // 2 as "row", col - i % 2 as col, max(z) filter (i = 0) as z0, max(z) filter (i = 1) as z1, max(z) filter (i = 2) as z2, max(z) filter (i = 3) as z3 from hills, (select unnest(range(4)) as i) group by all),
  m as (select id, "row", col, k, {", ".join(map(_corner, range(4)))} from b, square),
  q as (select id, "row", col, {", ".join(f"(rr{i} / (ff{i} * k) + 1) * 8 as x{i}, 16 - (uu{i} / (ff{i} * k) + 1) * 8 as y{i}, ff{i} as d{i}" for i in range(4))} from m),
  tri as (select id, "row", col, {", ".join(f"if(upper, {v}{i}, {v}{j}){' - 0.5' * (v != 'd')} as {v}{n}" for n, i, j in (("a", 0, 3), ("b", 1, 2), ("c", 2, 1)) for v in "xyd")} from q, (select unnest([true, false]) as upper)),
  g as (select *, (xb - xa) * (yc - ya) - (xc - xa) * (yb - ya) as area from tri where da > 0 and db > 0 and dc > 0 and greatest(xa, xb, xc) >= 0 and least(xa, xb, xc) <= 15 and greatest(ya, yb, yc) >= 0 and least(ya, yb, yc) <= 15),
  gu as (select *, unnest(range(greatest(ceil(least(xa, xb, xc)), 0)::bigint, least(floor(greatest(xa, xb, xc)), 15)::bigint + 1)) as u from g), gv as (select *, unnest(range(greatest(ceil(least(ya, yb, yc)), 0)::bigint, least(floor(greatest(ya, yb, yc)), 15)::bigint + 1)) as v from gu),
  inside as (select *, ((xb - u) * (yc - v) - (xc - u) * (yb - v)) / area as wa, ((xc - u) * (ya - v) - (xa - u) * (yc - v)) / area as wb, ((xa - u) * (yb - v) - (xb - u) * (ya - v)) / area as wc from gv where area <> 0),
  surface as (select id, v, u, min(1 / (wa / da + wb / db + wc / dc)) as near, arg_min(("row", col), 1 / (wa / da + wb / db + wc / dc)) as cell from inside where wa >= 0 and wb >= 0 and wc >= 0 group by id, v, u)"""


def _shots(spark, sf):
    t = plans.telemetry(spark, sf).selectExpr("flight_id", "frame", "id", "3 + id * 37 % 9400 / 100.0D as east", "3 + id * 53 % 4400 / 100.0D as north", "15.3D + id % 7 as up", "id % 30 + 0.37D as tilt", "id * 17 % 360 + 0.21D as heading", "roll + 0.13D as roll")
    hills = plans.cut(_heights(spark, sf).withColumn("z", F.col("z") * 0.1))
    return t, hills, shots.surfaces(hills, t, 50, 1.0, 30.0, 16.0, 16.0, (16, 16))


@query(f"with {_HEIGHTS}, {_SHOTS} select id, v, u, round(near, 4) as depth from surface")
def nearest_surfaces(spark, sf):
    """Depth of the terrain in each cell of each shot."""
    t, _, surface = _shots(spark, sf)
    return surface.join(t.select("flight_id", "frame", "id"), ["flight_id", "frame"]).select("id", "v", "u", F.round("depth", 4).alias("depth"))


@query(f"""with {_HEIGHTS}, {_SHOTS}, open as (select s.* from seen s left join surface f on f.id = s.id and f.v = floor(s.py) and f.u = floor(s.px) where s.d > 0 and s.px >= 0 and s.px < 16 and s.py >= 0 and s.py < 16 and (f.near is null or s.d <= f.near + 0.5))
select "row", col, arg_min((id % 97 + floor(px) + 16 * floor(py)), d)::double as value, count(*) as layers from open group by all""")
def shots_on_terrain(spark, sf):
    """A mosaic of what all shots see of the terrain, hidden cells left out, the nearest camera's picture on top."""
    t, hills, surface = _shots(spark, sf)
    cells = hills.selectExpr("row", "col", "cast(col as double) as x", "cast(49 - row as double) as y", "z")
    open_cells = shots.visible(cells, surface, t, 30.0, 16.0, 16.0, (16, 16), None, 0.5)
    pixel = (F.col("shot") % 97 + F.col("pcol") + 16 * F.col("prow")).cast("double")
    return shots.drawn(open_cells, pixel, t.select("flight_id", "frame", F.col("id").alias("shot"))).select("row", "col", "value", "layers")


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, round(epoch(ts), 3) as epoch from events""")
def event_properties(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("epoch"))


@query("""select page_id, regexp_extract(url, '://([^/]+)/', 1) as host, try_cast(regexp_extract(url, '.*[^0-9]([0-9]+)', 1) as bigint) as last_number from pages""")
def page_names(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "://([^/]+)/", 1).alias("host"), F.expr("try_cast(regexp_extract(url, '.*[^0-9]([0-9]+)', 1) as bigint)").alias("last_number"))


@query("""select flight_id, class_id, count(*) as n, grouping(class_id) as whole from det group by rollup (flight_id, class_id)""")
def class_rollup(spark, sf):
    return plans.detections(spark, sf).rollup("flight_id", "class_id").agg(F.count("*").alias("n"), F.grouping("class_id").cast("long").alias("whole"))


@query("""select flight_id, date_trunc('hour', ts)::varchar as start, count(*) as n, round(sum(alt), 3) as total from tele group by all""")
def hourly_windows(spark, sf):
    return plans.telemetry(spark, sf).groupBy("flight_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("alt"), 3).alias("total")).select("flight_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


# ------------------------------------------- unions, poses, gaps, contours


@query("""with k as (select *, unnest(range(round(x1 * 5)::bigint, round(x2 * 5)::bigint)) as c from det), r as (select flight_id, c, unnest(range(round(y1 * 10)::bigint, round(y2 * 10)::bigint)) as r from k)
select flight_id, round(count(*) / 50.0e0, 4) as area from (select distinct flight_id, c, r from r) group by 1""")
def footprint_unions(spark, sf):
    """Exact areas; the SQL counts cells of the grid that all corners lie on."""
    d = plans.detections(spark, sf).withColumn("ring", F.slice(boxes.ring(boxes.box()), 1, 4))
    return rasters.union_area_exact(d, "flight_id").select("flight_id", F.round("area", 4).alias("area"))


@query("""with d as (select flight_id, x1::bigint * 2 as cx, y1::bigint * 3 + frame % 40 as cy, row_id % 6 + 1 as r from det), k as (select distinct *, unnest(range(cx + cy - r, cx + cy + r)) as u from d), c as (select distinct *, unnest(range(cx - cy - r, cx - cy + r)) as v from k)
select flight_id, count(*) / 2.0e0 as area from (select distinct flight_id, u, v from c) group by 1""")
def turned_unions(spark, sf):
    """Exact areas of squares that stand on a corner; the SQL counts cells of a grid turned as they are, each half a square metre."""
    d = plans.detections(spark, sf).selectExpr("flight_id", "x1 * 2 as cx", "y1 * 3 + frame % 40 as cy", "cast(row_id % 6 + 1 as double) as r")
    at = lambda x, y: F.struct((F.col("cx") + x * F.col("r")).alias("x"), (F.col("cy") + y * F.col("r")).alias("y"))
    return rasters.union_area_exact(d.withColumn("ring", F.array(at(0, -1), at(1, 0), at(0, 1), at(-1, 0))), "flight_id").select("flight_id", F.round("area", 4).alias("area"))


@query(f"""with {_UTM} select id, round(east - 425405.337, 2) as east, round(north - 5316784.018, 2) as north, round(alt - 300, 4) as up, round(pitch + 90, 4) as tilt, round(heading, 4) as heading from utm""")
def log_poses(spark, sf):
    lat, lon = geodesy.from_utm(F.lit(425405.337), F.lit(5316784.018), EPSG)
    lat, lon = spark.range(1).select(lat, lon).first()
    t = plans.telemetry(spark, sf).withColumn("gimbal_pitch", F.col("pitch")).withColumn("gimbal_heading", F.col("heading")).withColumn("compass_heading", F.col("heading") + 30)
    p = georeference.pose_rows(t, {"lat": lat, "lon": lon, "alt": 300.0}, EPSG, 50.0)
    return p.select("id", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), *r4("up", "tilt", "heading"))


@query("""select id, floor(epoch(ts) - 5400)::bigint as utc from tele""")
def photo_times(spark, sf):
    t = plans.telemetry(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return t.select("id", F.floor(F.unix_micros(georeference.photo_time(F.col("ts"), F.lit(None).cast("timestamp"), 1.5)) / 1e6).cast("long").alias("utc"))


@query("""with r as (select flight_id, frame, case when id % 3 > 0 then alt end as v from tele), k as (select *, row_number() over (partition by flight_id order by frame) as i from r where v is not null), n as (select *, count(*) over (partition by flight_id) as n, lead(frame) over (partition by flight_id order by frame) as f2, lead(v) over (partition by flight_id order by frame) as v2 from k)
select r.flight_id, r.frame, round(coalesce(r.v, n.v + (n.v2 - n.v) * (r.frame - n.frame) / (n.f2 - n.frame)), 3) as alt from r left join n on r.v is null and r.flight_id = n.flight_id and n.f2 is not null and (r.frame > n.frame or n.i = 1) and (r.frame < n.f2 or n.i = n.n - 1)""")
def heights_without_gaps(spark, sf):
    t = plans.telemetry(spark, sf).select("flight_id", "frame", F.when(F.col("id") % 3 > 0, F.col("alt")).alias("alt"))
    return georeference.filled_by_place(t, ["alt"]).select("flight_id", "frame", F.round("alt", 3).alias("alt"))


@query("""with c as (select row_id, trunc((x1 + x2) / 2) as cx, trunc((y1 + y2) / 2) as cy, unnest([struct_pack(x := x2, y := y1, i := 0), struct_pack(x := x1, y := y1, i := 1), struct_pack(x := x1, y := y2, i := 2), struct_pack(x := x2, y := y2, i := 3)]) as p from det)
select row_id, string_agg(p.i::varchar, '' order by round(atan2(p.y - cy, p.x - cx), 9), p.i) as corners from c group by 1""")
def contour_order(spark, sf):
    d = plans.detections(spark, sf)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("x2", "y1"), at("x1", "y1"), at("x1", "y2"), at("x2", "y2"))
    name = lambda p: F.when((p["x"] == F.col("x2")) & (p["y"] == F.col("y1")), "0").when(p["y"] == F.col("y1"), "1").when(p["x"] == F.col("x1"), "2").otherwise("3")
    return d.select("row_id", F.array_join(F.transform(georeference.clockwise(ring), name), "").alias("corners"))


@query("""select flight_id, frame from det where class_id = 0 intersect select flight_id, frame from det where class_id = 1""")
def frames_of_both_classes(spark, sf):
    d = plans.detections(spark, sf)
    return d.where("class_id = 0").select("flight_id", "frame").intersect(d.where("class_id = 1").select("flight_id", "frame"))


@query("""select flight_id, class_id from det except all select flight_id, class_id from det where confidence >= 0.7""")
def classes_left(spark, sf):
    d = plans.detections(spark, sf)
    return d.select("flight_id", "class_id").exceptAll(d.where("confidence >= 0.7").select("flight_id", "class_id"))


@query("""select flight_id, class_id, count(*) as n, grouping(flight_id) * 2 + grouping(class_id) as level from det group by cube (flight_id, class_id)""")
def class_cube(spark, sf):
    return plans.detections(spark, sf).cube("flight_id", "class_id").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""select id, ntile(4) over (partition by flight_id order by alt, id) as quarter, round(percent_rank() over (partition by flight_id order by alt), 6) as rank from tele""")
def height_quarters(spark, sf):
    t, w = plans.telemetry(spark, sf), Window.partitionBy("flight_id")
    return t.select("id", F.ntile(4).over(w.orderBy("alt", "id")).alias("quarter"), F.round(F.percent_rank().over(w.orderBy("alt")), 6).alias("rank"))


@query(f"""with {_MOD}, a1 as (select frame, min(cx) as ax, min(cy) as ay from ma group by 1 having count(*) = 1), b1 as (select frame, min(cx) as bx, min(cy) as bya from mb group by 1 having count(*) = 1)
select round(sqrt(avg(power(0.9 * ax + 0.1 * ay + 2 - bx, 2) + power(-0.1 * ax + 0.9 * ay - 1 - bya, 2))), 6) as rmse from a1 join b1 using (frame)""")
def map_error(spark, sf):
    a, b = _modalities(spark, sf)
    pairs = a.select(F.col("frame").alias("frame_a"), F.col("frame").alias("frame_b")).distinct()
    return tracks.rmse(tracks.seed_pairs(a, b, pairs), (0.9, 0.1, -0.1, 0.9, 2.0, -1.0)).select(F.round("rmse", 6).alias("rmse"))


@query(f"""with {_STRATA} select stratum, count(*) as n_transects, sum("count")::bigint as total_count, round(sum(area_ha)::double, 4) as total_ha, round(sum("count") / sum(area_ha) * 100, 4) as naive, round(sum("count") / sum(area_ha) * 250, 4) as animals from strata group by 1""")
def population_naive(spark, sf):
    p = estimators.population(_strata(spark, sf), ("naive",), 250.0)
    return p.select("stratum", "n_transects", "total_count", F.round(F.col("total_ha").cast("double"), 4).alias("total_ha"), F.round("naive", 4).alias("naive"), F.round("naive_animals", 4).alias("animals"))


@query("""with f as (select flight_id, frame, row_number() over (partition by flight_id order by is_video, frame) - 1 as i from tele) select flight_id, frame, i as "index" from f where i >= 2 and (i - 2) % 3 = 0 and i - 2 < 30""")
def sampled_videos(spark, sf):
    f = georeference.global_index(plans.telemetry(spark, sf).select("flight_id", "frame", F.col("is_video").alias("video")))
    return georeference.sampled_index(f, 2, 3, 10).select("flight_id", "frame", F.col("index").cast("long").alias("index"))


@query("""select frame, flight_id, count(*) as boxes, min(row_id) as first from det group by all""")
def frames_with_boxes(spark, sf):
    d = plans.detections(spark, sf)
    frames = d.select("flight_id", "frame").distinct().unionByName(spark.createDataFrame([(-1, -1)], "flight_id long, frame long"))
    out = georeference.with_boxes(frames, d.select("flight_id", "frame", "row_id", "x1"))
    return out.select("flight_id", "frame", F.size("boxes").cast("long").alias("boxes"), F.col("boxes")[0]["row_id"].alias("first"))


@query(f"""with {_RANGES} select t.flight_id, t.frame, round(coalesce((select r.tx from ranges r where r.flight_id = t.flight_id and t.frame > r.s and (r.e is null or t.frame < r.e) order by ord desc limit 1), -1.0e0), 2) as tx from tele t""")
def corrections_last_inside(spark, sf):
    t = plans.telemetry(spark, sf)
    r = t.select("flight_id").distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("start_frame", F.col("ord") * 15 + F.col("flight_id") % 7)
    r = r.withColumn("end_frame", F.when(F.col("ord") < 3, F.col("start_frame") + 20)).withColumn("tx", F.col("ord") * 0.5)
    return georeference.last_inside(t.select("flight_id", "frame"), r, ["tx"], {"tx": -1.0}).select("flight_id", "frame", F.round("tx", 2).alias("tx"))


@query()
def tracker_each(spark, sf):
    return tracking.track_each(_tracks(spark, sf), least=0.3)


@query("""with o as (select flight_id, x, y, greatest(500 - x, 0, x - 4000) as dx, greatest(400 - y, 0, y - 5000) as dy from route)
select flight_id, count(*) filter (dx = 0 and dy = 0) as inside, count(*) as total, round(max(sqrt(dx * dx + dy * dy)), 3) as farthest, round(count(*) filter (dx = 0 and dy = 0) * 100.0e0 / count(*), 4) as percent, count(*) filter (dx = 0 and dy = 0) = count(*) as valid from o group by 1""")
def terrain_coverage(spark, sf):
    out = georeference.coverage_report(plans.routes(spark, sf), (510.0, 410.0, 3990.0, 4990.0), 10.0)
    return out.select("flight_id", "inside", "total", F.round("farthest", 3).alias("farthest"), F.round("percent", 4).alias("percent"), "valid")


@query("""with t as (select r * 4 + c as tile, c * 25 as x, r * 20 as y from range(0, 3) a(r), range(0, 4) b(c)), p as (select tile, y1::bigint as "row", x1::bigint as col, max(row_id % 101 + tile * 0.5e0) as value from det join t on x1 between x and x + 29 and y1 between y and y + 24 group by all)
select "row", col, arg_max(value, tile) as value from p group by all""")
def tile_mosaic(spark, sf):
    """Pictures of tiles that overlap, put together."""
    t = spark.range(3).withColumnRenamed("id", "r").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("r") * 4 + F.col("c")).alias("tile"), (F.col("c") * 25).alias("x"), (F.col("r") * 20).alias("y"))
    d = plans.detections(spark, sf).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("x1 between c * 25 and c * 25 + 29 and y1 between r * 20 and r * 20 + 24")
    cells = d.groupBy((F.col("r") * 4 + F.col("c")).alias("tile"), (F.col("y1").cast("long") - F.col("r") * 20).alias("row"), (F.col("x1").cast("long") - F.col("c") * 25).alias("col")).agg(F.max(F.col("row_id") % 101 + (F.col("r") * 4 + F.col("c")) * 0.5).alias("value"))
    return rasters.tiled_mosaic(cells, t)


@query("""with e as (select flight_id, max(alt) as hi from tele group by 1) select id, floor(greatest(0, least(1, (alt - 100) / (case when hi <= 100 then 1 else hi - 100 end))) * 255)::int as level, alt >= 100 as shown from tele join e using (flight_id)""")
def thermal_levels(spark, sf):
    t = plans.telemetry(spark, sf).select(F.col("flight_id").alias("file"), "id", F.col("alt").alias("value"))
    return rasters.colour_levels(t, low=100.0).select("id", "level", "shown")


@query("""with t as (select (r * 4 + c)::bigint as tile, c * 28.0e0 as x1, r * 18.0e0 as y1, c * 28.0e0 + 30 as x2, r * 18.0e0 + 20 as y2 from range(0, 3) a(r), range(0, 4) b(c))
select tile, row_id from t join det d on t.x1 <= d.x2 and d.x1 <= t.x2 and t.y1 <= d.y2 and d.y1 <= t.y2""")
def tiles_of_frames(spark, sf):
    t = spark.range(12).select(F.col("id"), (F.col("id") % 4 * 28.0).alias("x1"), (F.floor(F.col("id") / 4) * 18.0).alias("y1"))
    t = t.withColumn("x2", F.col("x1") + 30).withColumn("y2", F.col("y1") + 20)
    d = plans.detections(spark, sf).select(F.col("row_id").alias("id"), "x1", "y1", "x2", "y2")
    return joins.overlap_join(t, d, 10.0).select(F.col("a_id").alias("tile"), F.col("b_id").alias("row_id"))


@query(f"""with {_UTM} select id, round(east - 425405.337, 2) as east, round(north - 5316784.018, 2) as north, round(alt - 300, 4) as up, round((pitch + 90 + 360) % 360, 4) as tilt, round((heading + 360) % 360, 4) as heading, round(lat, 7) as lat, round(lon, 7) as lon, round(pitch, 4) as pitch from utm""")
def poses_there_and_back(spark, sf):
    origin = geodesy.origin(48.0, 14.0, 300.0, EPSG) | {"east": 425405.337, "north": 5316784.018}
    p = georeference.local_poses(plans.telemetry(spark, sf).withColumn("yaw", F.col("heading")), origin)
    p = p.select("id", "east", "north", "up", "tilt", "roll", "heading")
    back = georeference.geographic_poses(p, origin)
    return back.select("id", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), *r4("up", "tilt", "heading"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("pitch", 4).alias("pitch"))


@query(f"""with {_TR}, n as (select *, lead(frame) over w as f2, lead(x1) over w as x12, lead(case when row_id % 5 = 0 then 0 else x1 * 2 end) over w as p2, case when row_id % 5 = 0 then 0 else x1 * 2 end as p1 from tr window w as (partition by flight_id, track_id order by frame, row_id))
select flight_id, track_id, frame, round(x1 + 3.12e-6, 4) as x1, round(p1 + 3.12e-6, 4) as px1, false as interpolated from n
union all select flight_id, track_id, f, round(x1 + (x12 - x1) * ((f - n.frame) / (f2 - n.frame)) + 3.12e-6, 4), round(p1 + (p2 - p1) * ((f - n.frame) / (f2 - n.frame)) + 3.12e-6, 4), true from n, lateral (select unnest(range(n.frame + 1, f2)) as f)""")
def tracks_with_pixels(spark, sf):
    t = _tracks(spark, sf).withColumn("source_id", F.col("row_id") + 1)
    p = t.where("row_id % 5 > 0").select("flight_id", F.col("row_id").alias("place"), *[(F.col(c) * 2).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return georeference.tracks_in_both(t, p).select("flight_id", "track_id", "frame", *even4("x1", "px1"), "interpolated")


@query(f"""with {_PICTURES} select flight_id, tile, round(100 + x * 500.0e0 / width, 4) as min_x, round(900 - (y + h) * (175.0e0 + n) / height, 4) as min_y, round(100 + (x + w) * 500.0e0 / width, 4) as max_x, round(900 - y * (175.0e0 + n) / height, 4) as max_y from tile""")
def tile_bounds(spark, sf):
    """World bounds of the tiles of each flight's picture."""
    t = rasters.tile_extents(_picture_tiles(spark, sf), (F.lit(100.0), 725.0 - F.col("n"), F.lit(600.0), F.lit(900.0)), F.col("width"), F.col("height"))
    return t.select("flight_id", "tile", *r4("min_x", "min_y", "max_x", "max_y"))


@query("""with c as (select 0.0818191908426215e0 as e, radians(49) as p1, radians(44) as p2, radians(46.5) as p0), m as (select *, cos(p1) / sqrt(1 - power(e * sin(p1), 2)) as m1, cos(p2) / sqrt(1 - power(e * sin(p2), 2)) as m2, atanh(sin(p1)) - e * atanh(e * sin(p1)) as s1, atanh(sin(p2)) - e * atanh(e * sin(p2)) as s2, atanh(sin(p0)) - e * atanh(e * sin(p0)) as s0 from c),
  n as (select *, ln(m1 / m2) / (s2 - s1) as n from m), k as (select *, 6378137 * m1 * exp(n * s1) / n as k from n), r as (select id, lat, lon, n, k * exp(-n * s0) as r0, k * exp(-n * (atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat))))) as r from tele, k)
select id, round(6378137 * radians(lon), 3) as web_x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) as web_y, round(700000 + r * sin(n * radians(lon - 3)), 3) as cone_x, round(6600000 + r0 - r * cos(n * radians(lon - 3)), 3) as cone_y, round(lat, 9) as lat, round(lon, 9) as lon from r""")
def projected_positions(spark, sf):
    """Positions on a web map and on a conformal cone, and back through a chain of three projections."""
    t = plans.telemetry(spark, sf)
    web, cone, strip = projections.of(3857), projections.of(2154), projections.TransverseMercator(16 + 1 / 3, 1.0, 0.0, -5_000_000.0)
    t = t.withColumns(dict(zip(("web_x", "web_y"), web.forward(F.col("lat"), F.col("lon")), strict=True)))
    t = projections.reprojected(t.withColumns({"cone_x": F.col("web_x"), "cone_y": F.col("web_y")}), "cone_x", "cone_y", web, cone)
    t = projections.reprojected(t.withColumns({"strip_x": F.col("cone_x"), "strip_y": F.col("cone_y")}), "strip_x", "strip_y", cone, strip)
    lat, lon = strip.inverse(F.col("strip_x"), F.col("strip_y"))
    return t.select("id", *[F.round(c, 3).alias(c) for c in ("web_x", "web_y", "cone_x", "cone_y")], F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(f"""with {_HEIGHTS}, cells as (select r as "row", c as col, degrees(atan(sinh((6106900 - (r + 0.5) * 25) / 6378137))) as lat, degrees((1558250 + (c + 0.5) * 25) / 6378137) as lon from range(0, 90) a(r), range(0, 130) b(c)),
  {_UTM.replace("from tele)", "from cells)")}, p as (select "row", col, (east - 425000) / 20 - 0.5 as x, (5317500 - north) / 20 - 0.5 as y from utm),
  q as (select p.*, x - floor(x) as tx, y - floor(y) as ty, a.z as z0, b.z as z1, c.z as z2, d.z as z3 from p join h a on a."row" = floor(y) and a.col = floor(x) join h b on b."row" = floor(y) and b.col = floor(x) + 1 join h c on c."row" = floor(y) + 1 and c.col = floor(x) join h d on d."row" = floor(y) + 1 and d.col = floor(x) + 1)
select "row", col, round((1 - ty) * ((1 - tx) * z0 + tx * z1) + ty * ((1 - tx) * z2 + tx * z3), 4) as value from q""")
def warped_heights(spark, sf):
    """A field of heights on a UTM grid, drawn on the grid of a web map."""
    h = _heights(spark, sf).withColumnRenamed("z", "value")
    out = rasters.warped(h, {"min_x": 425000.0, "max_y": 5317500.0, "cell": 20.0}, projections.of(EPSG), {"min_x": 1558250.0, "max_y": 6106900.0, "cell": 25.0, "width": 130, "height": 90}, projections.of(3857))
    return out.select("row", "col", F.round("value", 4).alias("value"))
