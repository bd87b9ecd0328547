"""Aggregates over tracks and pairs of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from .joins import overlap_join


def class_vote(tracks: DataFrame, least: float = 0.7, weighted: bool = True, keys: tuple[str, ...] = ("flight_id", "track_id")) -> DataFrame:
    """Each track's class among boxes of at least that confidence: the highest mean confidence, or the most boxes; the first seen on ties; confidence is the mean over all boxes of that class."""
    per = tracks.groupBy(*keys, "class_id").agg(F.avg(F.when(F.col("confidence") >= least, F.col("confidence"))).alias("_m"), F.sum((F.col("confidence") >= least).cast("int")).alias("_n"), F.min(F.when(F.col("confidence") >= least, F.struct("frame", "row_id"))).alias("_f"), F.avg("confidence").alias("confidence"))
    score = F.round("_m", 9) if weighted else F.col("_n").cast("double")
    w = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), F.col("_f").asc_nulls_last(), "class_id")
    best = per.where("_n > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "class_id", "confidence")
    return tracks.select(*keys).distinct().join(best, list(keys), "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def movement(tracks: DataFrame, distance: float, absolute: int | None = None, relative: float | None = None, both: bool = False, keys: tuple[str, ...] = ("flight_id", "track_id")) -> DataFrame:
    """Per track of two rows or more: distances from its mean centre, how many are outliers, and moved by the thresholds given."""
    b = boxes.box()
    w = Window.partitionBy(*keys)
    d = tracks.select(*keys, boxes.centre_x(b).alias("cx"), boxes.centre_y(b).alias("cy"))
    dx, dy = F.col("cx") - F.avg("cx").over(w), F.col("cy") - F.avg("cy").over(w)
    d = d.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("_d") > distance).cast("long")).alias("outliers"), F.max("_d").alias("max_distance"), F.avg("_d").alias("mean_distance"), F.stddev_pop("_d").alias("std_distance")).where("n >= 2")
    tests = [F.col("outliers") >= absolute] * (absolute is not None) + [F.col("outliers") / F.col("n") >= relative] * (relative is not None)
    moved = tests[0] if tests else F.col("outliers") > 0
    for t in tests[1:]:
        moved = moved & t if both else moved | t
    return d.withColumn("moved", moved)


def candidates(a: DataFrame, b: DataFrame, pairs: DataFrame, affine: tuple[float, ...] = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)) -> DataFrame:
    """Per pair of tracks seen in paired frames: shared frames, exact median distance of a's centre under the map to b's, and both mean confidences.

    a, b: frame, track_id, cx, cy, confidence; pairs: frame_a, frame_b."""
    m, c, d, e, tx, ty = affine
    l = a.select(F.col("frame").alias("frame_a"), F.col("track_id").alias("track_t"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    r = b.select(F.col("frame").alias("frame_b"), F.col("track_id").alias("track_w"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    j = l.join(pairs, "frame_a").join(r, "frame_b")
    dx, dy = F.col("ax") * m + F.col("ay") * c + tx - F.col("bx"), F.col("ax") * d + F.col("ay") * e + ty - F.col("by")
    each = j.groupBy("track_t", "track_w", F.sqrt(dx * dx + dy * dy).alias("_d")).agg(F.count("*").alias("_n"))  # equal distances are dealt out once, with their number
    out = each.groupBy("track_t", "track_w").agg(F.sum("_n").alias("shared"), F.percentile("_d", F.lit(0.5), F.col("_n")).alias("median_dist"))
    conf = lambda t, n, o: t.groupBy(F.col("track_id").alias(n)).agg(F.avg("confidence").alias(o))
    return out.join(conf(a, "track_t", "conf_t"), "track_t").join(conf(b, "track_w", "conf_w"), "track_w")


def gate(cands: DataFrame, shared: int = 8, distance: float = 28.0, confidence: float = 0.20) -> DataFrame:
    """candidates with rejected: the first gate that a pair fails, null if it passes all."""
    reason = F.when(F.col("shared") < shared, "shared").when(F.col("median_dist") >= distance, "distance").when((F.col("conf_t") < confidence) | (F.col("conf_w") < confidence), "confidence")
    return cands.withColumn("rejected", reason)


def seed_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of paired frames that hold one row on either side."""
    single = lambda t, f, p: t.groupBy(F.col("frame").alias(f)).agg(F.count("*").alias("_n"), F.first("cx").alias(f"{p}x"), F.first("cy").alias(f"{p}y")).where("_n = 1").drop("_n")
    return pairs.join(single(a, "frame_a", "a"), "frame_a").join(single(b, "frame_b", "b"), "frame_b")


def affine_sums(pairs: DataFrame) -> DataFrame:
    """The sums of which least squares for x' and y' are made; of one row."""
    ax, ay = F.col("ax"), F.col("ay")
    sums = {"n": F.count("*"), "sx": F.sum(ax), "sy": F.sum(ay), "sxx": F.sum(ax * ax), "sxy": F.sum(ax * ay), "syy": F.sum(ay * ay)}
    for t in ("bx", "by"):
        sums |= {f"{t}1": F.sum(t), f"{t}x": F.sum(F.col(t) * ax), f"{t}y": F.sum(F.col(t) * ay)}
    return pairs.agg(*[v.alias(k) for k, v in sums.items()])


def fit_affine(pairs: DataFrame) -> tuple[float, ...] | None:
    """(a, b, c, d, tx, ty) by least squares from the sums over all pairs; None for under 3 pairs or pairs on a line."""
    import numpy as np

    s = affine_sums(pairs).first()
    if s.n < 3:
        return None
    m = np.array([[s.sxx, s.sxy, s.sx], [s.sxy, s.syy, s.sy], [s.sx, s.sy, s.n]])
    if np.linalg.matrix_rank(m, tol=1e-6 * max(1.0, float(np.abs(m).max()))) < 3:
        return None
    (a, b, tx), (c, d, ty) = np.linalg.solve(m, [s.bxx, s.bxy, s.bx1]), np.linalg.solve(m, [s.byx, s.byy, s.by1])
    return float(a), float(b), float(c), float(d), float(tx), float(ty)


def best_partner(frames: DataFrame, least: float, key: str = "frame", cell: float = 10.0) -> DataFrame:
    """Per box, the other box of its frame with the largest overlap of at least `least` (over 0), smaller row_id on ties.

    Boxes meet in cells of a grid over their frame, each pair once and for both sides; a box's best is a partial aggregate."""
    d = frames.select(key, F.col("row_id").alias("id"), "x1", "y1", "x2", "y2")
    j = overlap_join(d, d, cell, key, with_boxes=True).where("a_id < b_id").withColumn("iou", boxes.iou(boxes.box("a_"), boxes.box("b_"))).where(F.col("iou") >= F.lit(least).cast("float"))
    sides = F.array(F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b")), F.struct(F.col("b_id").alias("a"), F.col("a_id").alias("b")))
    best = F.min(F.struct((-F.round("iou", 5)).alias("k"), F.col("s.b").alias("b"), "iou"))
    return j.select(key, F.explode(sides).alias("s"), "iou").groupBy(key, F.col("s.a").alias("a_id")).agg(best.alias("v")).select(key, "a_id", F.col("v.b").alias("b_id"), "v.iou")


def fragments(tracks: DataFrame, min_length: int = 4, max_gap: int = 2, least: float = 0.5, ratio: float = 0.5) -> DataFrame:
    """Short tracks with the long track that each joins: frames apart by 0 to max_gap, no frame in common, overlap or nearness of the facing ends; the best score, then the smaller gap.

    tracks: flight_id, track_id, frame, box. Ends meet on flight and on cells of frames as wide as the gap; short tracks, the many, stand in one cell each."""
    keys = ["flight_id", "track_id"]
    # a track's boxes are dealt once, for its frames, its ends and all that follows from either
    dealt = tracks.select(*keys, "frame", "row_id", "x1", "y1", "x2", "y2").repartition(*keys)
    end = F.struct("frame", "row_id", "x1", "y1", "x2", "y2")
    frames = dealt.groupBy(*keys, "frame").agg(F.min(end).alias("first"), F.max(end).alias("last"))
    ends = frames.groupBy(*keys).agg(F.count("frame").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    short, long = ends.where(F.col("n") < min_length), ends.where(F.col("n") >= min_length)

    def meet(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
        """a ends, b begins 1 to max_gap + 1 frames later."""
        cell = lambda f: F.floor(f / (max_gap + 1))
        x = a.select("flight_id", F.col("track_id").alias(a_name), F.col("last").alias("p"), cell(F.col("last.frame")).alias("_cell"))
        y = b.select("flight_id", F.col("track_id").alias(b_name), F.col("first").alias("q"), cell(F.col("first.frame")).alias("_cell"))
        if a_name == "long":  # long tracks are the few: they stand in both cells, short ones in their own
            x = x.withColumn("_cell", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)))
        else:
            y = y.withColumn("_cell", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"))))
        j = x.join(y, ["flight_id", "_cell"]).withColumn("gap", F.col("q.frame") - F.col("p.frame") - 1)
        return j.where(F.col("gap").between(0, max_gap)).select("flight_id", "short", "long", "p", "q", "gap")

    j = meet(short, long, "short", "long").unionByName(meet(long, short, "long", "short"))
    p, q = (tuple(F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")) for s in "pq")
    j = j.withColumn("iou", boxes.iou(p, q)).withColumn("near", boxes.centre_distance(p, q) / F.greatest(F.lit(1e-9), (boxes.diagonal(p) + boxes.diagonal(q)) / 2)).where((F.col("iou") >= least) | (F.col("near") <= ratio))
    seen = tracks.select(*keys, "frame").repartition(*keys).distinct()
    # frames of the few short tracks of candidates, looked up among those of their long ones
    common = j.select("flight_id", "short", "long").distinct().join(seen.withColumnRenamed("track_id", "short"), ["flight_id", "short"])
    common = common.join(seen.withColumnRenamed("track_id", "long"), ["flight_id", "long", "frame"], "left_semi")
    j = j.join(common, ["flight_id", "short", "long"], "left_anti")
    w = Window.partitionBy("flight_id", "short").orderBy(F.round((1 - F.col("iou")) + F.col("near"), 6), "gap", "long")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("flight_id", "short", "long", "gap")


def rmse(pairs: DataFrame, affine: tuple[float, ...]) -> DataFrame:
    """Root mean square distance of partners (ax, ay, bx, by) under the map; infinite without any."""
    a, b, c, d, tx, ty = affine
    dx, dy = F.col("ax") * a + F.col("ay") * b + tx - F.col("bx"), F.col("ax") * c + F.col("ay") * d + ty - F.col("by")
    return pairs.agg(F.coalesce(F.sqrt(F.avg(dx * dx + dy * dy)), F.lit(float("inf"))).alias("rmse"))


def frame_pairs(mapped: DataFrame) -> DataFrame:
    """Rows (frame_a, frame_b) of a map of frames, those that meet no frame (null or below 0) left out."""
    return mapped.where("frame_b >= 0").select("frame_a", "frame_b")


def kept_boxes(tracks: DataFrame, condition) -> DataFrame:
    """Boxes of tracks that pass a condition on columns; a track without any left is gone."""
    return tracks.where(condition)
