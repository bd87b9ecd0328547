"""Grids as long tables of cells (row 0 is north)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes


def extent(points: DataFrame, cell: float, pad: float = 0.0, most: int = 8192) -> dict:
    """Bounds, cell size, width and height of a grid over the points; the cell grows where a side would pass `most`. One row comes to the driver."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        return {"min_x": 0.0, "min_y": 0.0, "max_x": 0.0, "max_y": 0.0, "cell": cell, "width": 0, "height": 0}
    x1, y1, x2, y2 = r[0] - pad, r[1] - pad, r[2] + pad, r[3] + pad
    w, h = max(1, math.ceil((x2 - x1) / cell)), max(1, math.ceil((y2 - y1) / cell))
    if max(w, h) > most:
        cell *= max(w, h) / most
        w, h = max(1, math.ceil((x2 - x1) / cell)), max(1, math.ceil((y2 - y1) / cell))
    return {"min_x": x1, "min_y": y1, "max_x": x1 + w * cell, "max_y": y1 + h * cell, "cell": cell, "width": w, "height": h}


def cell_of(x: Column, y: Column, grid: dict) -> tuple[Column, Column]:
    """Row and column of a point; may lie outside the grid."""
    return F.floor((grid["max_y"] - y) / grid["cell"]).cast("long"), F.floor((x - grid["min_x"]) / grid["cell"]).cast("long")


def binned(points: DataFrame, grid: dict) -> DataFrame:
    row, col = cell_of(F.col("x"), F.col("y"), grid)
    row, col = (F.greatest(F.lit(0), F.least(v, F.lit(n - 1))).cast("long") for v, n in ((row, grid["height"]), (col, grid["width"])))
    return points.select(row.alias("row"), col.alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))


def kernel(sigma: float, cut: float = 4.0) -> list[float]:
    """Weights of a Gaussian from 0 outward, cut at `cut` sigmas, with sum 1 over both sides."""
    reach = int(cut * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(reach + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [v / total for v in w]


def density(points: DataFrame, cell: float = 5.0, bandwidth: float = 25.0) -> DataFrame:
    """Density per hectare of each cell that a point reaches: counts smoothed along rows, then along columns.

    Each pass spreads a count over the kernel's width and sums, so the work follows occupied cells and not the grid."""
    grid = extent(points, cell, 3 * bandwidth)
    weights = kernel(bandwidth / grid["cell"])
    offsets = F.array(*[F.struct(F.lit(i).cast("long").alias("d"), F.lit(weights[abs(i)]).alias("w")) for i in range(1 - len(weights), len(weights))])

    def spread(cells: DataFrame, along: str, across: str, size: int) -> DataFrame:
        out = cells.withColumn("_o", F.explode(offsets)).withColumn(along, F.col(along) + F.col("_o.d")).withColumn("v", F.col("v") * F.col("_o.w"))
        return out.where(F.col(along).between(0, size - 1)).groupBy(along, across).agg(F.sum("v").alias("v"))

    cells = spread(spread(binned(points, grid).select("row", "col", F.col("n").cast("double").alias("v")), "col", "row", grid["width"]), "row", "col", grid["height"])
    return cells.select("row", "col", (F.col("v") / (grid["cell"] ** 2 / 10_000)).alias("density"))


def _row_spans(rings: DataFrame, x0: float, y0: float, cell: float, down: bool) -> DataFrame:
    """rings with a row for each stretch of cells of a grid's row whose centres a ring (array of points) holds: row, and its first and last column lo and hi. Rows count down or up from y0.

    A ring's edges are met once a row, at the height of the row's centres, and pair up from left to right."""
    sign = -1 if down else 1
    e = rings.withColumn("_e", boxes.extent(F.col("ring"))).where("_e.x1 is not null")
    near, far = ((y0 - F.col("_e.y2"), y0 - F.col("_e.y1")) if down else (F.col("_e.y1") - y0, F.col("_e.y2") - y0))
    low, high = F.ceil(near / cell - 0.5), F.floor(far / cell - 0.5)
    e = e.where(low <= high).withColumn("row", F.explode(F.sequence(low, high))).withColumn("_y", y0 + sign * (F.col("row") + 0.5) * cell)

    def crossing(p, i):
        q = F.get(F.col("ring"), (i + 1) % F.size("ring"))
        at = p["x"] + (F.col("_y") - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return F.when((p["y"] <= F.col("_y")) != (q["y"] <= F.col("_y")), at)

    e = e.withColumn("_xs", F.array_sort(F.filter(F.transform("ring", crossing), lambda x: x.isNotNull())))
    pairs = F.filter(F.transform("_xs", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get(F.col("_xs"), i + 1).alias("b")))), lambda p: p.isNotNull())
    e = e.withColumn("_p", F.explode(pairs)).withColumn("lo", F.ceil((F.col("_p.a") - x0) / cell - 0.5)).withColumn("hi", F.floor((F.col("_p.b") - x0) / cell - 0.5))
    return e.where("lo <= hi").drop("_e", "_y", "_xs", "_p")


def coverage(footprints: DataFrame, cell: float = 1.0) -> DataFrame:
    """How many rings (ring: array of points) hold each cell's centre. Equal rings are laid on the grid once, with their number."""
    b = footprints.select(boxes.extent(F.col("ring")).alias("_e")).agg(F.min("_e.x1"), F.max("_e.y2")).first()
    if b[0] is None:
        return footprints.sparkSession.createDataFrame([], "row long, col long, n long")
    each = footprints.groupBy("ring").agg(F.count("*").alias("_n"))
    cells = _row_spans(each, b[0], b[1], cell, True).select("row", F.explode(F.sequence("lo", "hi")).alias("col"), "_n")
    return cells.groupBy("row", "col").agg(F.sum("_n").alias("n"))


def render_size(width_m: float, height_m: float, resolution: float | None = None, fixed: int | None = None, most: int | None = None) -> tuple[int, int]:
    """Pixels of a picture: metres by resolution, rounded up, or a fixed longer side; never over `most`."""
    if resolution:
        w, h = math.ceil(width_m / resolution), math.ceil(height_m / resolution)
    else:
        scale = fixed / max(width_m, height_m)
        w, h = round(width_m * scale), round(height_m * scale)
    if most and max(w, h) > most:
        w, h = w * most // max(w, h), h * most // max(w, h)
    return max(1, w), max(1, h)


def tiles(spark, width: int, height: int, size: int, overlap: int = 0) -> DataFrame:
    """Tiles of a picture by rows: tile, x, y, w, h."""
    step = size - overlap
    t = spark.range(math.ceil(height / step)).withColumnRenamed("id", "r").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(width / step) - 1))))
    return t.select((F.col("r") * math.ceil(width / step) + F.col("c")).alias("tile"), (F.col("c") * step).cast("long").alias("x"), (F.col("r") * step).alias("y"), F.least(F.lit(size), width - F.col("c") * step).cast("long").alias("w"), F.least(F.lit(size), height - F.col("r") * step).cast("long").alias("h"))


def picture_tiles(pictures: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """pictures (width, height) with a row for each of their tiles, numbered by rows: tile, x, y, w, h."""
    step = size - overlap
    many = lambda n: F.ceil(F.col(n) / step)
    t = pictures.withColumn("_r", F.explode(F.sequence(F.lit(0), many("height") - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), many("width") - 1)))
    x, y = F.col("_c") * step, F.col("_r") * step
    part = lambda n, at: F.least(F.lit(size), F.col(n) - at).cast("long")
    return t.select(*pictures.columns, (F.col("_r") * many("width") + F.col("_c")).alias("tile"), x.alias("x"), y.alias("y"), part("width", x).alias("w"), part("height", y).alias("h"))


def tile_extents(tiles: DataFrame, bounds: tuple, width, height) -> DataFrame:
    """tiles (x, y, w, h in pixels from the upper left) with the world bounds of what each shows, of a picture of the given size over the bounds; bounds and sizes are numbers or columns."""
    sx, sy = (bounds[2] - bounds[0]) / width, (bounds[3] - bounds[1]) / height
    x, y = F.col("x"), F.col("y")
    return tiles.select("*", (bounds[0] + x * sx).alias("min_x"), (bounds[3] - (y + F.col("h")) * sy).alias("min_y"), (bounds[0] + (x + F.col("w")) * sx).alias("max_x"), (bounds[3] - y * sy).alias("max_y"))


def eroded(cells: DataFrame, times: int = 1) -> DataFrame:
    """Valid cells (row, col) whose four neighbours are valid, again and again; what lies outside is not valid."""
    for _ in range(times):
        reach = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
        votes = cells.select("row", "col").withColumn("_o", F.explode(reach)).select((F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"))
        cells = votes.groupBy("row", "col").agg(F.count("*").alias("_n")).where("_n = 5").select("row", "col")
    return cells


def cropped(cells: DataFrame, padding: int = 0) -> DataFrame:
    """Cells counted from the first occupied row and column, less the padding."""
    first = cells.agg((F.min("row") - padding).alias("_r"), (F.min("col") - padding).alias("_c"))
    return cells.crossJoin(F.broadcast(first)).withColumn("row", F.col("row") - F.col("_r")).withColumn("col", F.col("col") - F.col("_c")).drop("_r", "_c")  # one row


def mosaic(cells: DataFrame, how: str = "average") -> DataFrame:
    """One value a cell (row, col) of layers (value, shot, distance): the mean, rounded half to even; the first or last shot; or that nearest to the centre."""
    value = {"average": F.bround(F.avg("value"), 0), "first": F.min_by("value", "shot"), "last": F.max_by("value", "shot"), "center": F.min_by("value", F.struct("distance", "shot"))}[how]
    return cells.where("value is not null").groupBy("row", "col").agg(value.alias("value"), F.count("*").alias("layers"))


def sampled(heights: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """points (px, py from the top left corner) with z of the heightfield (row, col, z), linear on two triangles a cell; null outside or at missing heights."""
    p = points.withColumn("_c", F.floor(F.col("px") / cell)).withColumn("_r", F.floor(F.col("py") / cell))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i // 2).alias("r"), F.lit(i % 2).alias("c")) for i in range(4)])
    h = heights.where("z is not null").withColumn("_o", F.explode(corners)).select((F.col("row") - F.col("_o.r")).alias("_r"), (F.col("col") - F.col("_o.c")).alias("_c"), F.col("_o.i").alias("i"), "z")
    q = h.groupBy("_r", "_c").agg(*[F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"_z{i}") for i in range(4)])
    j = p.join(q, ["_r", "_c"], "left")
    tx, ty = F.col("px") / cell - F.col("_c"), F.col("py") / cell - F.col("_r")
    upper = F.col("_z0") + tx * (F.col("_z1") - F.col("_z0")) + ty * (F.col("_z2") - F.col("_z0"))
    lower = F.col("_z3") + (1 - tx) * (F.col("_z2") - F.col("_z3")) + (1 - ty) * (F.col("_z1") - F.col("_z3"))
    return j.withColumn("z", F.when(tx + ty <= 1, upper).otherwise(lower)).select(*points.columns, "z")


def heightfield_mesh(heights: DataFrame, width: int, height: int, cell: float, base: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, x, y, z) and faces (a, b, c) of a grid of heights; missing ones lie at the base."""
    v = heights.select((F.col("row") * width + F.col("col")).alias("v"), (F.col("col") * cell).alias("x"), ((height - 1 - F.col("row")) * cell).alias("y"), F.coalesce("z", F.lit(base)).alias("z"))
    at = heights.where((F.col("row") < height - 1) & (F.col("col") < width - 1)).select((F.col("row") * width + F.col("col")).alias("i"))
    face = lambda a, b, c: F.struct((F.col("i") + a).alias("a"), (F.col("i") + b).alias("b"), (F.col("i") + c).alias("c"))
    return v, at.select(F.inline(F.array(face(0, width, 1), face(1, width, width + 1))))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The unit mean of the normals of the faces at each vertex; faces without area have none, and a vertex of such faces alone gets 0."""
    f = faces
    for n in "abc":
        f = f.join(vertices.select(F.col("v").alias(n), F.struct("x", "y", "z").alias(f"p{n}")), n)
    u, v = ([F.col(f"p{n}.{k}") - F.col(f"pa.{k}") for k in "xyz"] for n in "bc")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum((k * k for k in n[1:]), n[0] * n[0]))
    per = f.select(F.explode(F.array("a", "b", "c")).alias("v"), *[(k / F.nullif(size, F.lit(0.0))).alias(f"n{i}") for i, k in enumerate(n)])
    s = per.groupBy("v").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    size = F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2"))
    return s.select("v", *[F.coalesce(F.col(f"n{i}") / F.nullif(size, F.lit(0.0)), F.lit(0.0)).alias(k) for i, k in enumerate(("nx", "ny", "nz"))])


def union_area(rings: DataFrame, key: str, cell: float) -> DataFrame:
    """Area of the union of a key's rings, by cells whose centre is inside: exact up to the cells that borders cut. Equal rings are laid on the grid once; stretches of a row that overlap are joined, so no cell is a row by itself, and of those that begin at one cell the longest is dealt out."""
    s = _row_spans(rings.select(key, "ring").distinct(), 0.0, 0.0, cell, False).groupBy(key, "row", "lo").agg(F.max("hi").alias("hi"))
    before = F.max("hi").over(Window.partitionBy(key, "row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_n", F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before + 1, F.col("lo"))) + 1))
    return s.groupBy(key).agg((F.sum("_n") * cell * cell).alias("area"))


# A trapezoid lies between two heights: low, high, left and right at low, left and right at high.
_LOW, _HIGH, _L0, _R0, _L1, _R1 = range(6)


def trapezoids(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple rings of one number of corners (a row each) cut at the heights of their corners, and each trapezoid's ring."""
    x2, y2 = np.roll(xs, -1, 1), np.roll(ys, -1, 1)
    low, high, flat = np.minimum(ys, y2), np.maximum(ys, y2), ys == y2
    with np.errstate(invalid="ignore", divide="ignore"):
        rise = np.where(flat, 0.0, (x2 - xs) / np.where(flat, 1.0, y2 - ys))
    cuts, out, owner = np.sort(ys, 1), [], []
    for a, b in zip(cuts.T[:-1, :, None], cuts.T[1:, :, None], strict=True):
        live = (low <= a) & (high >= b) & (a < b)
        # a side's own corners are taken as they are
        at = lambda y: np.where(ys == y, xs, np.where(y2 == y, x2, xs + (y - ys) * rise))  # noqa: E731, B023
        lo, hi = at(a), at(b)
        order = np.argsort(np.where(live, lo + hi, np.inf), 1, kind="stable")
        lo, hi, n = np.take_along_axis(lo, order, 1), np.take_along_axis(hi, order, 1), live.sum(1)
        if (n % 2).any():
            raise ValueError("a ring's edges do not pair up")
        for k in range(0, int(n.max(initial=0)), 2):
            i = np.flatnonzero(n > k)
            out.append(np.stack([a[i, 0], b[i, 0], lo[i, k], lo[i, k + 1], hi[i, k], hi[i, k + 1]], 1))
            owner.append(i)
    return np.concatenate([*out, np.zeros((0, 6))]), np.concatenate([*owner, np.zeros(0, np.int64)])


def _between(t: np.ndarray, a: float, b: float) -> np.ndarray:
    """Trapezoids cut to heights a to b."""
    t = t[(t[:, _HIGH] > a) & (t[:, _LOW] < b)]
    if not len(t) or ((t[:, _LOW] >= a).all() and (t[:, _HIGH] <= b).all()):
        return t
    lo, hi = np.maximum(t[:, _LOW], a), np.minimum(t[:, _HIGH], b)
    size = t[:, _HIGH] - t[:, _LOW]
    p, q = (lo - t[:, _LOW]) / size, (hi - t[:, _LOW]) / size
    p[lo == t[:, _LOW]], q[hi == t[:, _HIGH]] = 0.0, 1.0
    at = lambda k0, k1, s: np.where(s == 1.0, t[:, k1], t[:, k0] + s * (t[:, k1] - t[:, k0]))
    return np.stack([lo, hi, at(_L0, _L1, p), at(_R0, _R1, p), at(_L0, _L1, q), at(_R0, _R1, q)], 1)


def _merged(t: np.ndarray) -> np.ndarray:
    """Trapezoids of one pair of heights, from left to right, without those that others hold; those that make one with their neighbour joined."""
    t = t[np.lexsort((-t[:, _R0], t[:, _L1], t[:, _L0]))]
    reach0, reach1 = np.maximum.accumulate(t[:, _R0]), np.maximum.accumulate(t[:, _R1])
    far = np.maximum.accumulate(np.where(t[:, _R0] == reach0, np.arange(len(t)), 0))  # which reaches farthest so far
    held = np.r_[False, (t[1:, _L1] >= t[far[:-1], _L1]) & (t[1:, _R0] <= t[far[:-1], _R0]) & (t[1:, _R1] <= t[far[:-1], _R1])]
    out: list[list[float]] = []
    for row in t[~held].tolist():
        if out:
            last = out[-1]
            if row[_L1] >= last[_L1] and row[_L0] <= last[_R0] and row[_L1] <= last[_R1] and (row[_R0] - last[_R0]) * (row[_R1] - last[_R1]) >= 0:
                last[_R0], last[_R1] = max(row[_R0], last[_R0]), max(row[_R1], last[_R1])
                continue
        out.append(row)
    return np.array(out).reshape(-1, 6)


def outline(t: np.ndarray) -> np.ndarray:
    """Disjoint trapezoids of the same union.

    Between two heights, those that span both are merged, and what lies within one of these is dropped with all its corners;
    where others remain, the stretch is cut at the middle of their corners, and where sides cross, at crossings, each half by itself."""
    done: list[np.ndarray] = []
    work = [(t, float(t[:, _LOW].min()), float(t[:, _HIGH].max()))] if len(t) else []
    while work:
        t, a, b = work.pop()
        t = _between(t, a, b)
        if not len(t):
            continue
        spans = (t[:, _LOW] <= a) & (t[:, _HIGH] >= b)
        full, part = t[spans], t[~spans]
        if len(full):
            full = _merged(full)
        if len(part) and len(full):
            # a part within the merged one that begins last before it
            lo, hi = (part[:, _LOW] - a) / (b - a), (part[:, _HIGH] - a) / (b - a)
            k = np.maximum(np.searchsorted(full[:, _L0], part[:, _L0], "right") - 1, 0)
            side = lambda c0, c1, s: full[k, c0] + s * (full[k, c1] - full[k, c0])  # noqa: E731, B023
            part = part[~((part[:, _L0] >= side(_L0, _L1, lo)) & (part[:, _L1] >= side(_L0, _L1, hi)) & (part[:, _R0] <= side(_R0, _R1, lo)) & (part[:, _R1] <= side(_R0, _R1, hi)))]
        if len(part):
            inner = np.concatenate([part[:, _LOW], part[:, _HIGH]])
            inner = np.sort(inner[(inner > a) & (inner < b)])
            cut = float(inner[len(inner) // 2])
        else:
            free = (full[1:, _L0] >= full[:-1, _R0]) & (full[1:, _L1] >= full[:-1, _R1])
            if free.all():
                done.append(full)
                continue
            cut = _crossing(full, a, b)
            if cut is None:
                done.append(_by_middle(full, a, b))
                continue
        both = np.concatenate([full, part])
        work += [(both, a, cut), (both, cut, b)]
    return np.concatenate(done) if done else np.zeros((0, 6))


def _crossing(t: np.ndarray, a: float, b: float) -> float | None:
    """The middle one of the heights within a to b at which sides of neighbours cross; where no neighbours' do, of those of any two."""
    for near in (True, False):
        first, second = (np.arange(len(t) - 1), np.arange(1, len(t))) if near else np.triu_indices(len(t), 1)
        found = []
        for p, q in (((_L0, _L1), (_L0, _L1)), ((_L0, _L1), (_R0, _R1)), ((_R0, _R1), (_L0, _L1)), ((_R0, _R1), (_R0, _R1))):
            d0, d1 = t[first, p[0]] - t[second, q[0]], t[first, p[1]] - t[second, q[1]]
            cross = d0 * d1 < 0
            found.append(d0[cross] / (d0[cross] - d1[cross]))
        s = np.concatenate(found)
        y = np.sort(a + s * (b - a))
        y = y[(y > a + 1e-12 * (b - a)) & (y < b - 1e-12 * (b - a))]
        if len(y):
            return float(y[len(y) // 2])
    return None


def _by_middle(t: np.ndarray, a: float, b: float) -> np.ndarray:
    """Spans of trapezoids whose sides keep their order between a and b: joined where they overlap in the middle."""
    l, r = (t[:, _L0] + t[:, _L1]) / 2, (t[:, _R0] + t[:, _R1]) / 2
    order = np.argsort(l)
    l, r, t = l[order], r[order], t[order]
    reach = np.maximum.accumulate(r)
    begin = np.flatnonzero(np.r_[True, l[1:] > reach[:-1]])
    far = [int(i + np.argmax(r[i:j])) for i, j in zip(begin, [*begin[1:], len(t)], strict=True)]
    return np.stack([np.full(len(begin), a), np.full(len(begin), b), t[begin, _L0], t[far, _R0], t[begin, _L1], t[far, _R1]], 1)


def _area(t: np.ndarray) -> float:
    return float(((t[:, _HIGH] - t[:, _LOW]) * (t[:, _R0] - t[:, _L0] + t[:, _R1] - t[:, _L1])).sum() / 2)


_CORNERS = ["low", "high", "l0", "r0", "l1", "r1"]


def union_area_exact(rings: DataFrame, key: str, strip: float | None = None, crowd: int = 4096) -> DataFrame:
    """Exact area of the union of a key's rings (simple, of any shape; corners that are null are left out).

    Equal rings are taken once. Rings become trapezoids, cut into strips of y whose areas add up: of the given height, or of one by which a strip has some
    `crowd` rings, but not below their mean height. Each task first unites what it holds of a strip, so that rings
    which others hold are gone, and only an outline is dealt out, before a strip's outlines meet; so the rows of a strip follow
    the outline's corners and not the number of rings."""
    ring = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    e = rings.select(F.col(key).alias("_key"), F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring")).where(F.size("ring") > 2).distinct().withColumn("_e", boxes.extent(F.col("ring")))
    if strip is None:
        per = e.groupBy("_key").agg(F.count("*").alias("n"), F.avg(F.col("_e.y2") - F.col("_e.y1")).alias("mean"), (F.max("_e.y2") - F.min("_e.y1")).alias("whole"))
        tall = F.greatest(F.col("mean"), F.col("whole") * crowd / F.col("n"), F.col("whole") * 1e-6)
        e = e.join(per.select(F.col("_key").alias("_of"), F.when(tall > 0, tall).otherwise(1.0).alias("_tall")), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
    else:
        e = e.withColumn("_tall", F.lit(float(strip)))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    e = e.select("_key", "_tall", xs.alias("xs"), ys.alias("ys"))
    kind = dict(rings.dtypes)[key]
    schema = f"_key {kind}, _strip long, {', '.join(f'{c} double' for c in _CORNERS)}"

    def pieces(batches):
        for pdf in batches:
            size, parts, owners = pdf["xs"].map(len).to_numpy(), [np.zeros((0, 6))], [np.zeros(0, np.int64)]
            for m in np.unique(size):
                rows = np.flatnonzero(size == m)
                part, of = trapezoids(np.stack(pdf["xs"].to_numpy()[rows]), np.stack(pdf["ys"].to_numpy()[rows]))
                parts.append(part)
                owners.append(rows[of])
            t, owner = np.concatenate(parts), np.concatenate(owners)
            tall = pdf["_tall"].to_numpy()[owner]
            codes, names = pd.factorize(pdf["_key"], use_na_sentinel=False)
            first, last = np.floor(t[:, _LOW] / tall).astype(np.int64), np.ceil(t[:, _HIGH] / tall).astype(np.int64)
            again = np.repeat(np.arange(len(t)), last - first)
            number = first[again] + np.arange(len(again)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
            order = np.lexsort((number, codes[owner][again]))
            again, number = again[order], number[order]
            code = codes[owner][again]
            cut = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(code) != 0)]) if len(again) else []
            found = []
            for i, j in zip(cut, [*cut[1:], len(again)], strict=True):
                h, here = tall[again[i]], t[again[i:j]]
                here = _between(here, number[i] * h, (number[i] + 1) * h)
                united = outline(here)
                found.append(united if len(united) < len(here) else here)
            if found:
                each = np.repeat(cut, [len(f) for f in found])
                out = pd.DataFrame(np.concatenate(found), columns=_CORNERS)
                out.insert(0, "_strip", number[each])
                out.insert(0, "_key", pd.Series(names[code[each]], dtype=pdf["_key"].dtype))
                yield out

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "a": [_area(outline(pdf[_CORNERS].to_numpy(float)))]})

    # small rows, much work: a fixed number of tasks, which adaptive planning doesn't fold into few
    tasks = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    united = e.repartition(tasks).mapInPandas(pieces, schema).repartition(tasks, "_key", "_strip")
    out = united.groupBy("_key", "_strip").applyInPandas(whole, f"_key {kind}, a double")
    return out.groupBy(F.col("_key").alias(key)).agg(F.sum("a").alias("area"))


def tiled_mosaic(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """Cells (tile, row, col, value; counted in their tile) of tiles placed at (tile, x, y) as one picture; where tiles overlap, the later tile wins."""
    at = cells.join(placed.select("tile", "x", "y"), "tile")
    return at.groupBy((F.col("row") + F.col("y")).alias("row"), (F.col("col") + F.col("x")).alias("col")).agg(F.max_by("value", "tile").alias("value"))


def quads(cells: DataFrame, value: str = "z") -> DataFrame:
    """Squares between four neighbouring cells (row, col, value): row and col of the upper left one, and z0 upper left, z1 upper right, z2 lower left, z3 lower right; null where one is missing."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i // 2).alias("r"), F.lit(i % 2).alias("c")) for i in range(4)])
    q = cells.where(F.col(value).isNotNull()).withColumn("_o", F.explode(corners)).select((F.col("row") - F.col("_o.r")).alias("row"), (F.col("col") - F.col("_o.c")).alias("col"), F.col("_o.i").alias("i"), F.col(value).alias("_z"))
    return q.groupBy("row", "col").agg(*[F.max(F.when(F.col("i") == i, F.col("_z"))).alias(f"z{i}") for i in range(4)])


def warped(cells: DataFrame, grid: dict, source, target_grid: dict, target, nearest: bool = False) -> DataFrame:
    """A raster (row, col, value) on grid (min_x, max_y, cell) of one projection as the cells (row, col, value) of target_grid (with width and height) of another.

    Each target cell asks for the value at its centre's place: linear between the four cells around it, which meet it by
    key, so neither raster is held in one task; or (nearest) of the cell that holds it. Where cells that count are missing, or
    the place has no image, the target has no row."""
    w = target_grid["width"]
    t = cells.sparkSession.range(w * target_grid["height"]).select(F.floor(F.col("id") / w).alias("row"), (F.col("id") % w).alias("col"))
    x, y = target_grid["min_x"] + (F.col("col") + 0.5) * target_grid["cell"], target_grid["max_y"] - (F.col("row") + 0.5) * target_grid["cell"]
    lat, lon = target.inverse(x, y)
    t = t.withColumn("_lat", lat).withColumn("_lon", lon)
    sx, sy = source.forward(F.col("_lat"), F.col("_lon"))
    t = t.select("row", "col", ((sx - grid["min_x"]) / grid["cell"]).alias("_x"), ((grid["max_y"] - sy) / grid["cell"]).alias("_y"))
    if nearest:
        at = t.withColumn("_r", F.floor("_y")).withColumn("_c", F.floor("_x"))
        return at.join(cells.where("value is not null").select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"]).select("row", "col", "value")
    at = t.withColumn("_r", F.floor(F.col("_y") - 0.5)).withColumn("_c", F.floor(F.col("_x") - 0.5))
    j = at.join(quads(cells, "value").withColumnsRenamed({"row": "_r", "col": "_c"}), ["_r", "_c"])
    tx, ty = F.col("_x") - 0.5 - F.col("_c"), F.col("_y") - 0.5 - F.col("_r")
    part = lambda share, z: F.when(share == 0, 0.0).otherwise(share * F.col(z))
    value = part((1 - tx) * (1 - ty), "z0") + part(tx * (1 - ty), "z1") + part((1 - tx) * ty, "z2") + part(tx * ty, "z3")
    return j.select("row", "col", value.alias("value")).where("value is not null")


def colour_levels(cells: DataFrame, low: float | None = None, high: float | None = None, key: str = "file") -> DataFrame:
    """cells (key, value) with level, 0 to 255 from the low to the high bound, and shown, false beyond a bound that is given; a bound that is not given is the picture's own extreme."""
    e = cells.groupBy(key).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    lo, hi = (F.lit(low) if low is not None else F.col("_lo")), (F.lit(high) if high is not None else F.col("_hi"))
    hi = F.when(hi <= lo, lo + 1.0).otherwise(hi)
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - lo) / (hi - lo)))
    shown = F.lit(True)
    if low is not None:
        shown = shown & (F.col("value") >= low)
    if high is not None:
        shown = shown & (F.col("value") <= high)
    return cells.join(e, key).withColumn("level", F.floor(level * 255).cast("int")).withColumn("shown", shown).drop("_lo", "_hi")


def ranked_top(rows: DataFrame, key: str, by: Column, n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by))).where(F.col("_r") <= n).drop("_r")
