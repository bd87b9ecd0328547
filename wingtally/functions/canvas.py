"""Canvases, tiles of a grid of maps, camera tables, and lens distortion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def padded_extent(extent: tuple[float, float, float, float], width: float, height: float, margin: float) -> tuple[float, float, float, float]:
    """The extent made larger on its short side, so that it has the shape of a canvas inside its margin."""
    x1, y1, x2, y2 = extent
    w, h = max(x2 - x1, 1e-9), max(y2 - y1, 1e-9)
    shape = (width - 2 * margin) / (height - 2 * margin)
    if w / h < shape:
        more = (h * shape - w) / 2
        return x1 - more, y1, x2 + more, y2
    more = (w / shape - h) / 2
    return x1, y1 - more, x2, y2 + more


def to_canvas(x: Column, y: Column, extent: tuple[float, float, float, float], width: int = 800, height: int = 800, margin: int = 60) -> tuple[Column, Column]:
    """Whole pixels on the canvas, from its top left."""
    x1, y1, x2, y2 = padded_extent(extent, width, height, margin)
    px = margin + (x - x1) / (x2 - x1) * (width - 2 * margin)
    return px.cast("int"), (height - margin - (y - y1) / (y2 - y1) * (height - 2 * margin)).cast("int")


def padded_box(lat1: float, lon1: float, lat2: float, lon2: float, metres: float = 0.0) -> tuple[float, float, float, float]:
    """South, west, north, east of two corners, with a border in metres."""
    d = metres / 111320.0
    e = d / math.cos(math.radians((lat1 + lat2) / 2))
    return min(lat1, lat2) - d, min(lon1, lon2) - e, max(lat1, lat2) + d, max(lon1, lon2) + e


def map_tiles(spark: SparkSession, west: float, south: float, east: float, north: float, size: float = 50_000.0) -> DataFrame:
    """Tiles of a metric grid that a box touches, by name: N and E of the lower left corner."""
    span = lambda a, b: F.sequence(F.lit(math.floor(a / size)).cast("long"), F.lit(math.floor(b / size)).cast("long"))
    t = spark.range(1).select(F.explode(span(south, north)).alias("r")).select("r", F.explode(span(west, east)).alias("c"))
    return t.select(F.format_string("N%dE%d", (F.col("r") * size).cast("long"), (F.col("c") * size).cast("long")).alias("tile"), (F.col("c") * size).alias("west"), (F.col("r") * size).alias("south"))


# Drones by the names that logs give them, and the sizes of their cameras.
DRONES = {"m2ea": "M2EA", "m3t": "M3T", "m3te": "M3T", "m30t": "M30T", "m30": "M30T", "m300": "M300"}
CAMERAS = [
    ("M2EA", "wide", 3840, 2160), ("M2EA", "thermal", 640, 512), ("M3T", "wide", 3840, 2160), ("M3T", "thermal", 640, 512), ("M3T", "zoom", None, None),
    ("M30T", "wide", 3840, 2160), ("M30T", "thermal", 1280, 1024), ("M30T", "zoom", None, None), ("M300", "wide", None, None), ("M300", "thermal", None, None), ("M300", "zoom", None, None),
]


def drone_of(name: Column, maker: str = "dji") -> Column:
    """The drone that a name stands for, in any case, with or without its maker and underscores; null for others."""
    bare = F.replace(F.replace(F.lower(name), F.lit(maker), F.lit("")), F.lit("_"), F.lit(""))
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in DRONES.items() for x in kv]), lambda k, v: k == bare)), F.lit(0))


def product_name(drone: Column, maker: str = "DJI") -> Column:
    return F.concat(F.lit(f"{maker}_"), drone)


def known_sensors(spark: SparkSession) -> DataFrame:
    """drone, camera, width and height of the cameras in CAMERAS; sizes that are not known are null."""
    return sensors(spark, CAMERAS)


def sensors(spark: SparkSession, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """A table of cameras that drones carry, with their sizes: (drone, camera, width, height)."""
    return spark.createDataFrame(rows, "drone string, camera string, width int, height int")


def undistorted(points: np.ndarray, matrix: np.ndarray, lens: np.ndarray, new: np.ndarray | None = None, rounds: int = 20) -> np.ndarray:
    """Pixels without the lens's distortion (k1, k2, p1, p2, k3, k4, k5, k6), by fixed-point iteration, under the new matrix."""
    k1, k2, p1, p2, k3, k4, k5, k6 = (*lens, *[0] * 8)[:8]
    new = matrix if new is None else new
    d = (points - matrix[:2, 2]) / matrix[[0, 1], [0, 1]]
    u = d.copy()
    for _ in range(rounds):
        x, y = u[:, 0], u[:, 1]
        r = x * x + y * y
        radial = (1 + r * (k1 + r * (k2 + r * k3))) / (1 + r * (k4 + r * (k5 + r * k6)))
        u = (d - np.stack([2 * p1 * x * y + p2 * (r + 2 * x * x), p1 * (r + 2 * y * y) + 2 * p2 * x * y], 1)) / radial[:, None]
    return u * new[[0, 1], [0, 1]] + new[:2, 2]


def undistort_boxes(boxes: DataFrame, matrix: np.ndarray, lens: np.ndarray, new: np.ndarray | None = None) -> DataFrame:
    """boxes with the extent of their four corners freed from distortion, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            at = [undistorted(pdf[[x, y]].to_numpy(float), matrix, lens, new) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
            low, high = np.minimum.reduce(at), np.maximum.reduce(at)
            yield pdf.assign(x1=low[:, 0], y1=low[:, 1], x2=high[:, 0], y2=high[:, 1])

    return boxes.mapInPandas(run, boxes.schema)


def _grid_extents(matrix: np.ndarray, lens: np.ndarray, size: tuple[int, int], n: int = 9) -> tuple[tuple, tuple]:
    """(x1, y1, x2, y2) of the largest box inside the undistorted picture and of the least box around it, from n x n points."""
    x, y = np.meshgrid(np.arange(n) * (size[0] - 1) / (n - 1), np.arange(n) * (size[1] - 1) / (n - 1))
    p = undistorted(np.stack([x.ravel(), y.ravel()], 1), matrix, lens).reshape(n, n, 2)
    u, v = p[:, :, 0], p[:, :, 1]
    return (u[:, 0].max(), v[0].max(), u[:, -1].min(), v[-1].min()), (u.min(), v.min(), u.max(), v.max())


def new_matrix(matrix: np.ndarray, lens: np.ndarray, size: tuple[int, int], new_size: tuple[int, int], alpha: float = 0.5, one_focus: bool = True) -> np.ndarray:
    """The matrix of undistorted pictures of new_size with the principal point in the middle: between the scale that shows only
    pixels of the source (alpha 0) and that which shows all of them (alpha 1); with one_focus both focal lengths are the larger."""
    inner, outer = _grid_extents(matrix, lens, size)
    cx0, cy0 = matrix[0, 2], matrix[1, 2]
    cx, cy = (new_size[0] - 1) * 0.5, (new_size[1] - 1) * 0.5
    ratios = lambda b: (cx / (cx0 - b[0]), cy / (cy0 - b[1]), cx / (b[2] - cx0), cy / (b[3] - cy0))
    scale = max(ratios(inner)) * (1 - alpha) + min(ratios(outer)) * alpha
    out = matrix.astype(float).copy()
    out[0, 0], out[1, 1], out[0, 2], out[1, 2] = out[0, 0] * scale, out[1, 1] * scale, cx, cy
    if one_focus:
        out[0, 0] = out[1, 1] = max(out[0, 0], out[1, 1])
    return out


def fovy_of(matrix: np.ndarray, height: float) -> float:
    """Vertical angle of view in degrees."""
    return math.degrees(2 * math.atan(height / (2 * matrix[1, 1])))


def undistort_points(points: DataFrame, matrix: np.ndarray, lens: np.ndarray, new: np.ndarray | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """points with x and y freed from distortion, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            p = undistorted(pdf[[x, y]].to_numpy(float), matrix, lens, new)
            yield pdf.assign(**{x: p[:, 0], y: p[:, 1]})

    return points.mapInPandas(run, points.withColumn(x, F.col(x).cast("double")).withColumn(y, F.col(y).cast("double")).schema)
