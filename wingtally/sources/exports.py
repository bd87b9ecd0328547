"""Exports of tracks, reports, logs and subtitles, and more dialects of track files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, optics
from .tracks import _cells, _long, _num


def read_geo_detections(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """`idx frame x1 y1 z1 x2 y2 z2 confidence class`, by commas or blanks; corners put in order (heights are not); confidence over `least`, strictly."""
    c = _cells(spark, path, r"[\s,]+", 10)
    x1, y1, x2, y2 = _num(2), _num(3), _num(5), _num(6)
    out = c.select("file", "row_id", _long(1).alias("frame"), F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), _num(4).alias("z1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"), _num(7).alias("z2"), _num(8).alias("confidence"), _long(9).alias("class_id"))
    return out.where(F.col("confidence") > least)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """`frame,id,left,top,width,height,...` of six cells or more; the confidence is the ninth, else 1. Rows that hold no numbers are left out."""
    c = _cells(spark, path, ",", 6)
    out = c.select("file", "row_id", _long(0).alias("frame"), _long(1).alias("track_id"), _num(2).alias("x1"), _num(3).alias("y1"), (_num(2) + _num(4)).alias("x2"), (_num(3) + _num(5)).alias("y2"), F.coalesce(_num(8), F.lit(1.0)).alias("confidence"))
    return out.where("x2 is not null and y2 is not null and track_id is not null")


def read_track_states(spark: SparkSession, path: str, labels: dict[str, int] | None = None) -> DataFrame:
    """A JSON list of tracks with states of pixel rings: a box is its ring's extent; labels give classes of species ids."""
    schema = "id long, speciesId string, states array<struct<frame:long,pxlCoordinates:array<struct<x:double,y:double>>>>"
    t = spark.read.schema(schema).json(path, multiLine=True).select("id", "speciesId", F.explode("states").alias("s"))
    ring = F.col("s.pxlCoordinates")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    kind = F.lit(None).cast("long")
    for name, number in (labels or {}).items():
        kind = F.when(F.col("speciesId") == name, number).otherwise(kind)
    return t.select(F.col("id").alias("track_id"), "s.frame", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"), kind.cast("long").alias("class_id"))


def _json(rows: DataFrame, value: Column, path: str) -> None:
    rows.select(F.to_json(value).alias("value")).write.mode("overwrite").text(path)


def write_track_states(tracks: DataFrame, votes: DataFrame, path: str) -> None:
    """Tracks with their voted class and confidence, states by frame with closed rings of whole pixels; one line of JSON a track."""
    corner = lambda x, y: F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    keys = ["flight_id", "track_id"]
    states = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", ring.alias("pxlCoordinates")))).alias("states"))
    _json(states.join(votes, keys), F.struct(F.col("track_id").alias("id"), "class_id", "confidence", "states"), path)


def write_nested_tracks(tracks: DataFrame, path: str, most_tracks: int = 100, most_frames: int = 1_000_000) -> None:
    """flight -> track (2 digits) -> frame (6 digits) -> four whole numbers; more tracks or higher frames than the digits hold raise."""
    box = F.array(*[F.floor(c) for c in ("x1", "y1", "x2", "y2")])
    ok = tracks.withColumn("_n", F.dense_rank().over(_by("flight_id", "track_id")) - 1)
    ok = ok.withColumn("_t", F.when(F.col("_n") < most_tracks, F.lpad(F.col("_n").cast("string"), 2, "0")).otherwise(F.raise_error(F.lit("too many tracks"))))
    ok = ok.withColumn("_f", F.when(F.col("frame") < most_frames, F.lpad(F.col("frame").cast("string"), 6, "0")).otherwise(F.raise_error(F.lit("frame number too high"))))
    frames = ok.groupBy("flight_id", "_t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_f", box.alias("box"))))).alias("frames"))
    flights = frames.groupBy("flight_id").agg(F.map_from_entries(F.collect_list(F.struct("_t", "frames"))).alias("tracks"))
    _json(flights, F.create_map(F.col("flight_id").cast("string"), F.col("tracks")), path)


def _by(key: str, by: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(by)


def write_perpendicular(rows: DataFrame, path: str, epsg: int) -> None:
    """Feet and distances (4 decimals) of one flight a line."""
    item = F.struct("point_id", F.array("px", "py").alias("centre"), F.array("foot_x", "foot_y").alias("foot"), F.round("distance", 4).alias("distance"))
    _json(rows.groupBy("flight_id").agg(F.array_sort(F.collect_list(item)).alias("items")), F.struct(F.lit(f"EPSG:{epsg}").alias("crs"), "flight_id", F.col("items").alias("perpendiculars")), path)


def write_transects(transects: DataFrame, path: str) -> None:
    item = F.struct(F.col("transect_id").alias("id"), F.coalesce("name", F.concat(F.lit("t"), F.col("transect_id").cast("string"))).alias("name"), "start_frame", "end_frame", F.round("length", 2).alias("length_m"))
    _json(transects.groupBy("flight_id").agg(F.array_sort(F.collect_list(item)).alias("transects")), F.struct("flight_id", "transects"), path)


def write_movement(report: DataFrame, path: str, kind: str = "csv") -> None:
    """The movement report as CSV with a header, or as lines of JSON."""
    out = report.orderBy("flight_id", "track_id")
    out.write.mode("overwrite").csv(path, header=True) if kind == "csv" else out.write.mode("overwrite").json(path)


def write_geojson_tracks(tracks: DataFrame, path: str, epsg: int) -> None:
    """A feature collection for each flight: per track its line (a lone point is doubled) in degrees and in its own colour."""
    lat, lon = geodesy.from_utm((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, epsg)
    line = tracks.groupBy("flight_id", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", lon.alias("lon"), lat.alias("lat")))), lambda p: F.array(p["lon"], p["lat"])).alias("line"))
    line = line.withColumn("line", F.when(F.size("line") == 1, F.concat("line", "line")).otherwise(F.col("line"))).withColumn("color", optics.colour_of(F.col("track_id")))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("track_id", "color").alias("properties"), geometry.alias("geometry"))
    _json(line.groupBy("flight_id").agg(F.collect_list(feature).alias("features")), F.struct(F.lit("FeatureCollection").alias("type"), "features"), path)


def write_telemetry(rows: DataFrame, path: str, epsg: int | None = None) -> None:
    """A log with units in its header, heights in feet and speeds in miles an hour; with a grid, positions in metres beside."""
    cols = [F.col("time").alias("time(millisecond)"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime(utc)"), F.col("latitude"), F.col("longitude"), (F.col("height") * 3.28).alias("height(feet)"), (F.col("speed") / 1.6093).alias("speed(mph)")]
    if epsg:
        e, n = geodesy.to_utm(F.col("latitude"), F.col("longitude"), epsg)
        ok = geodesy.valid_position(F.col("latitude"), F.col("longitude"))
        cols += [F.when(ok, e).alias("utm_x"), F.when(ok, n).alias("utm_y")]
    rows.orderBy("time").select(cols).write.mode("overwrite").csv(path, header=True)


def _clock(ms: str) -> Column:
    c = F.col(ms)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3_600_000), F.floor(c / 60_000) % 60, F.floor(c / 1000) % 60, c % 1000)


def subtitle_blocks(rows: DataFrame) -> DataFrame:
    """Rows (id from 0, start_ms, end_ms, ts, latitude, longitude, rel_alt, abs_alt) as blocks of a subtitle file."""
    tags = F.format_string("[latitude: %.6f] [longitude: %.6f] [rel_alt: %.3f abs_alt: %.3f]", "latitude", "longitude", "rel_alt", "abs_alt")
    head = F.format_string("%d\n%s --> %s", F.col("id") + 1, _clock("start_ms"), _clock("end_ms"))
    frame = F.format_string("FrameCnt: %d, DiffTime: %dms", F.col("id") + 1, F.col("end_ms") - F.col("start_ms"))
    return rows.select("id", F.concat_ws("\n", head, frame, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), tags, F.lit("")).alias("value"))


def write_subtitles(rows: DataFrame, path: str) -> None:
    subtitle_blocks(rows).orderBy("id").select("value").write.mode("overwrite").text(path)
