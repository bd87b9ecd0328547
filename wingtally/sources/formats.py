"""Formats by name: what reads and what writes each, and a place for those of a caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, exports, flights, pictures, rasters, tracks

Reader = Callable[..., DataFrame]
Writer = Callable[..., None]

_FORMATS: dict[str, tuple[Reader | None, Writer | None]] = {
    "detections": (tracks.read_detections, tracks.write_detections), "georeferenced": (tracks.read_georeferenced, tracks.write_georeferenced), "tracks": (tracks.read_tracks, tracks.write_tracks),
    "pixel_tracks": (tracks.read_pixel_tracks, tracks.write_pixel_tracks), "mot": (tracks.read_mot, tracks.write_mot), "yolo": (tracks.read_yolo, tracks.write_yolo), "labelbox": (tracks.read_labelbox, tracks.write_labelbox),
    "geo_tracks": (tracks.read_geo_tracks, None), "track_states": (exports.read_track_states, exports.write_track_states), "poses": (flights.read_poses, flights.write_poses), "corrections": (flights.read_corrections, None),
    "telemetry": (flights.read_telemetry, exports.write_telemetry), "subtitles": (flights.read_subtitles, exports.write_subtitles), "route": (flights.read_route, flights.write_route), "polygons": (flights.read_polygons, flights.write_polygons),
    "transects": (flights.read_transects, exports.write_transects), "perpendicular": (flights.read_perpendicular, exports.write_perpendicular), "calibration": (flights.read_calibration, None), "tracklets": (binary.read_tracklets, None),
    "mesh": (binary.read_mesh, None), "raster": (rasters.read_raster, None), "elevation": (rasters.read_elevation, None), "thermal": (binary.read_thermal, None), "picture_tags": (pictures.read_picture_tags, None),
}


def register(name: str, reader: Reader | None = None, writer: Writer | None = None) -> None:
    """Adds a format: a reader of (spark, path, options) to rows, a writer of (rows, path, options); it may take the place of one of that name."""
    _FORMATS[name] = (reader, writer)


def names() -> list[str]:
    return sorted(_FORMATS)


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Rows of files in a format; options are the reader's."""
    reader = _FORMATS.get(name, (None, None))[0]
    if reader is None:
        raise ValueError(f"no reader for {name!r}; there are {[n for n in names() if _FORMATS[n][0]]}")
    return reader(spark, path, **options)


def write(rows: DataFrame, name: str, path: str, **options) -> None:
    """Rows as files in a format; options are the writer's."""
    writer = _FORMATS.get(name, (None, None))[1]
    if writer is None:
        raise ValueError(f"no writer for {name!r}; there are {[n for n in names() if _FORMATS[n][1]]}")
    writer(rows, path, **options)
