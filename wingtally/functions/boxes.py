"""Boxes as columns (x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def centre_x(b: Box) -> Column:
    return (b[0] + b[2]) / 2


def centre_y(b: Box) -> Column:
    return (b[1] + b[3]) / 2


def diagonal(b: Box) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b))


def area(b: Box) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    dx, dy = centre_x(a) - centre_x(b), centre_y(a) - centre_y(b)
    return F.sqrt(dx * dx + dy * dy)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union as a float, which thresholds are compared in; 0 where no area is left."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0)).cast("float")


def overlaps(a: Box, b: Box, factor: float = 0.8) -> Column:
    return iou(a, b) > F.lit(factor).cast("float")


def from_size(left: Column, top: Column, w: Column, h: Column) -> Box:
    return left, top, left + w, top + h


def clipped(b: Box, to: tuple[float, float, float, float]) -> Box:
    x1, y1, x2, y2 = map(F.lit, to)
    return F.greatest(b[0], x1), F.greatest(b[1], y1), F.least(b[2], x2), F.least(b[3], y2)


def ring(b: Box) -> Column:
    """The closed ring of five corners."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(b[0], b[1]), corner(b[2], b[1]), corner(b[2], b[3]), corner(b[0], b[3]), corner(b[0], b[1]))


def extent(points: Column) -> Column:
    """Least and largest x and y of an array of points, without nulls and NaN; null members if none is left."""
    ok = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    xs, ys = F.transform(ok, lambda p: p["x"]), F.transform(ok, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def distance_to(x: Column, y: Column, b: Box) -> Column:
    """Distance of a point to a box; 0 inside."""
    dx = F.greatest(b[0] - x, F.lit(0.0), x - b[2])
    dy = F.greatest(b[1] - y, F.lit(0.0), y - b[3])
    return F.sqrt(dx * dx + dy * dy)


def to_yolo(b: Box, w: float, h: float) -> Box:
    """Centre and size as shares of the image, after clipping to it."""
    c = clipped(b, (0.0, 0.0, w, h))
    return centre_x(c) / w, centre_y(c) / h, width(c) / w, height(c) / h


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, image_w: float, image_h: float) -> Box:
    return (cx - w / 2) * image_w, (cy - h / 2) * image_h, (cx + w / 2) * image_w, (cy + h / 2) * image_h


def inside_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies in a ring of points or on its border; a null or empty ring holds nothing.

    Even-odd crossings over the ring's edges, in one pass of the array."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))

    def step(state: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on = (F.abs(cross) < 1e-12) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
        return F.struct((state["odd"] != F.coalesce(hit, F.lit(False))).alias("odd"), (state["on"] | on).alias("on"))

    last = F.aggregate(edges, F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on")), step)
    return F.when(n >= 3, last["odd"] | last["on"]).otherwise(F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row; written out in a lambda, it would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def ring_area(points: Column) -> Column:
    """Area of a ring by the shoelace rule."""

    def area(p: Column) -> Column:
        n = F.size(p)
        terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(p, i)["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * F.get(p, i)["y"])
        return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(F.lit(0.0))

    return bound(points, area)