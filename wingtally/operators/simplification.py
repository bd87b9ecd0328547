"""Simplification of lines of any length: level by level as aggregates, and short stretches in grouped tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut
from .tracking import kept_points


def simplify_long(points: DataFrame, tolerance: float, keys: tuple[str, ...] = ("flight_id", "track_id"), small: int = 50_000) -> DataFrame:
    """The rows (keys, frame, x, y) that Ramer, Douglas and Peucker keep of each line, as tracking.simplify gives them.

    While stretches have more than `small` points between their ends, the farthest point of each is found as a partial
    aggregate, its points are dealt to the two halves, and the level is cut from its lineage; points of stretches that keep
    none drop out. What is left goes to one task a stretch. So no task holds more than a stretch of `small` points, however
    long the line. Points of one frame stand by x and then y; those without a place are left out."""
    spark = points.sparkSession
    names = list(keys)
    order = [*names, "frame", "x", "y"]
    rows = points.where("x is not null and y is not null").select(*order)
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")))
    point = F.struct("at", "x", "y", "frame")
    ends = rows.groupBy(*names).agg(F.min(point).alias("a"), F.max(point).alias("b"), (F.count("*") - 2).alias("n"))
    as_row = lambda df, p: df.select(*names, F.col(f"{p}.frame").alias("frame"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
    kept = [as_row(ends, "a"), as_row(ends.where("b.at > a.at"), "b")]
    open_ = cut(rows.join(ends, names).where("at > a.at and at < b.at"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    qx, qy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    length = F.sqrt(dx * dx + dy * dy)  # as kept_points
    away = F.when(length > 0, F.abs(dx * qy - dy * qx) / length).otherwise(F.sqrt(qx * qx + qy * qy))
    short = []
    while True:
        short.append(open_.where(F.col("n") <= small))
        open_ = open_.where(F.col("n") > small)
        if open_.isEmpty():
            break
        far = open_.groupBy(*names, F.col("a.at").alias("_a")).agg(F.max(F.struct(away.alias("d"), "at", "x", "y", "frame")).alias("k")).where(F.col("k.d") > tolerance)
        far = cut(far.withColumn("k", F.struct("k.at", "k.x", "k.y", "k.frame")))
        kept.append(as_row(far, "k"))
        halves = open_.drop("n").withColumn("_a", F.col("a.at")).join(far, [*names, "_a"]).where("at <> k.at")
        first = F.col("at") < F.col("k.at")
        halves = cut(halves.withColumn("b", F.when(first, F.col("k")).otherwise(F.col("b"))).withColumn("a", F.when(first, F.col("a")).otherwise(F.col("k"))).drop("_a", "k"))
        sizes = halves.groupBy(*names, F.col("a.at").alias("_a")).agg(F.count("*").alias("n"))
        open_ = cut(halves.withColumn("_a", F.col("a.at")).join(sizes, [*names, "_a"]).drop("_a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        end = lambda c: pd.DataFrame({"x": [pdf[f"{c}x"].iloc[0]], "y": [pdf[f"{c}y"].iloc[0]]})
        line = pd.concat([end("a"), pdf[["x", "y"]], end("b")]).to_numpy(float)
        return pdf[kept_points(line, tolerance)[1:-1]][[*names, "frame", "x", "y"]]

    left = short[0]
    for s in short[1:]:
        left = left.unionByName(s)
    left = left.select(*names, "at", "frame", "x", "y", F.col("a.at").alias("_a"), *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    out = left.groupBy(*names, "_a").applyInPandas(run, kept[0].schema)
    for k in kept:
        out = out.unionByName(k)
    return out
