"""Readers and writers of detection and track files.

Lines are read as text and cut by column functions: blank lines, lines that start with '#', and lines whose first cell is no whole number are left out. Files are many and small, so row_id is the line's place in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cells(spark: SparkSession, path: str, separator: str, least: int) -> DataFrame:
    """file, row_id and the cells of each line of data."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("row_id", "line"))
    lines = lines.withColumn("cells", F.split(F.trim("line"), separator))
    return lines.where(F.get("cells", F.lit(0)).rlike(r"^\s*-?[0-9]+\s*$") & (F.size("cells") >= least)).select("file", F.col("row_id").cast("long").alias("row_id"), "cells")


def _num(i: int, kind: str = "double") -> Column:
    return F.expr(f"try_cast(trim(get(cells, {i})) as {kind})")


def _long(i: int) -> Column:
    return _num(i).cast("long")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """`frame x1 y1 x2 y2 [confidence [class]]`, by blanks."""
    c = _cells(spark, path, r"\s+", 5)
    return c.select("file", "row_id", _long(0).alias("frame"), *[_num(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)], F.coalesce(_num(5), F.lit(1.0)).alias("confidence"), F.coalesce(_long(6), F.lit(0).cast("long")).alias("class_id"))


def read_georeferenced(spark: SparkSession, path: str) -> DataFrame:
    """`idx frame x1 y1 z1 x2 y2 z2 [confidence [class]]`; idx is left out."""
    c = _cells(spark, path, r"\s+", 8)
    return c.select("file", "row_id", _long(1).alias("frame"), *[_num(i).alias(n) for i, n in enumerate(("x1", "y1", "z1", "x2", "y2", "z2"), 2)], F.coalesce(_num(8), F.lit(1.0)).alias("confidence"), F.coalesce(_long(9), F.lit(0).cast("long")).alias("class_id"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """`frame,track,x1,y1,z1,x2,y2,z2,confidence,class[,interpolated]`; a track of -1 is null."""
    c = _cells(spark, path, ",", 10)
    return c.select("file", "row_id", _long(0).alias("frame"), F.nullif(_long(1), F.lit(-1).cast("long")).alias("track_id"), *[_num(i).alias(n) for i, n in enumerate(("x1", "y1", "z1", "x2", "y2", "z2"), 2)], _num(8).alias("confidence"), _long(9).alias("class_id"), F.coalesce(_long(10) == 1, F.lit(False)).alias("interpolated"))


def read_geo_tracks(spark: SparkSession, path: str) -> DataFrame:
    """`frame track x1 y1 z1 x2 y2 z2 confidence class [visibility]`, by commas or blanks; lines of fewer cells, or with cells that hold no number, are left out."""
    c = _cells(spark, path, r"\s*,\s*|\s+", 10)
    names = ("x1", "y1", "z1", "x2", "y2", "z2", "confidence")
    whole = lambda i: F.expr(f"try_cast(trim(get(cells, {i})) as long)")
    out = c.select("file", "row_id", whole(0).alias("frame"), whole(1).alias("track_id"), *[_num(i).alias(n) for i, n in enumerate(names, 2)], whole(9).alias("class_id"), F.when(F.size("cells") > 10, _num(10)).otherwise(F.lit(1.0)).alias("visibility"))
    return out.dropna()


def sorted_tracks(rows: DataFrame) -> DataFrame:
    """rows in order of frame and track with source_id, their place from 0 in each file; a row without a track raises."""
    checked = F.when(F.col("track_id").isNull() | (F.col("track_id") < 0), F.raise_error(F.lit("rows without a track id"))).otherwise(F.col("track_id"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("row_id")) - 1
    return rows.withColumn("source_id", place).withColumn("track_id", checked).orderBy("file", "frame", "track_id")


def read_pixel_tracks(spark: SparkSession, path: str) -> DataFrame:
    """`frame,track,x1,y1,x2,y2,confidence,class[,interpolated]`, with or without a header."""
    c = _cells(spark, path, ",", 8)
    return c.select("file", "row_id", _long(0).alias("frame"), F.nullif(_long(1), F.lit(-1).cast("long")).alias("track_id"), *[_num(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 2)], _num(6).alias("confidence"), _long(7).alias("class_id"), F.coalesce(_long(8) == 1, F.lit(False)).alias("interpolated"))


def read_mot(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """`frame,id,left,top,width,height[,confidence[,class[,more]]]` as corners; the cells after the class are `extra`.

    strict: negative confidences and classes are null, and each row of a negative id is a track of its own."""
    c = _cells(spark, path, ",", 9 if strict else 6)
    x1, y1 = _num(2), _num(3)
    track, conf, kind = _long(1), F.coalesce(_num(6), F.lit(1.0)), F.coalesce(_long(7), F.lit(0).cast("long"))
    if strict:
        track, conf, kind = F.when(track < 0, -F.col("row_id") - 1).otherwise(track), F.when(_num(6) >= 0, _num(6)), F.when(_long(7) >= 0, _long(7))
    else:
        track = F.nullif(track, F.lit(-1).cast("long"))
    return c.select("file", "row_id", _long(0).alias("frame"), track.alias("track_id"), x1.alias("x1"), y1.alias("y1"), (x1 + _num(4)).alias("x2"), (y1 + _num(5)).alias("y2"), conf.alias("confidence"), kind.alias("class_id"), F.when(F.size("cells") > 8, F.slice("cells", 9, 1000)).otherwise(F.array().cast("array<string>")).alias("extra"))


def read_yolo(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """`class cx cy w h` as shares of the picture; the frame is the last run of digits in the file's name."""
    c = _cells(spark, path, r"\s+", 5)
    cx, cy, w, h = _num(1) * width, _num(2) * height, _num(3) * width, _num(4) * height
    frame = F.expr("try_cast(regexp_extract(regexp_replace(file, '[.][^./]*$', ''), '([0-9]+)[^0-9/]*$', 1) as long)")
    return c.select("file", "row_id", frame.alias("frame"), (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"), _long(0).alias("class_id"))


def read_labelbox(spark: SparkSession, path: str) -> DataFrame:
    """One track a segment, one box a key frame."""
    schema = "segments array<struct<keyframes:array<struct<frame:long,bbox:struct<left:double,top:double,width:double,height:double>,classifications:array<struct<answer:string>>>>>>"
    s = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("segments").alias("track_id", "s")).select(F.col("track_id").cast("long").alias("track_id"), F.explode("s.keyframes").alias("k"))
    b = F.col("k.bbox")
    return s.select("track_id", "k.frame", b["left"].alias("x1"), b["top"].alias("y1"), (b["left"] + b["width"]).alias("x2"), (b["top"] + b["height"]).alias("y2"), F.lit(1.0).alias("confidence"), F.get("k.classifications", F.lit(0))["answer"].alias("label"))


def _written(rows: DataFrame, line: Column, path: str, order: list, header: str | None) -> None:
    """Lines in order, one folder of text files; ordered by range, so the files in order are the whole."""
    out = rows.orderBy(*order).select(line.alias("value"))
    if header:
        out = rows.sparkSession.range(1).select(F.lit(header).alias("value")).unionByName(out)
    out.write.mode("overwrite").text(path)


def write_detections(rows: DataFrame, path: str) -> None:
    line = F.format_string("%d %.2f %.2f %.2f %.2f %.4f %d", "frame", "x1", "y1", "x2", "y2", "confidence", "class_id")
    _written(rows, line, path, ["row_id"], "# frame x1 y1 x2 y2 confidence class")


def write_georeferenced(rows: DataFrame, path: str) -> None:
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("row_id")) - 1)
    _written(n, F.format_string("%d %d %.6f %.6f %.6f %.6f %.6f %.6f %.4f %d", "_n", "frame", "x1", "y1", "z1", "x2", "y2", "z2", "confidence", "class_id"), path, ["file", "row_id"], "# idx frame min_x min_y min_z max_x max_y max_z confidence class")


def write_tracks(rows: DataFrame, path: str) -> None:
    line = F.format_string("%08d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,%d,%d", "frame", F.coalesce("track_id", F.lit(-1)), "x1", "y1", "z1", "x2", "y2", "z2", "confidence", "class_id", F.col("interpolated").cast("int"))
    _written(rows, line, path, ["frame", "track_id"], None)


def write_pixel_tracks(rows: DataFrame, path: str, style: str = "plugin") -> None:
    digits, frame = ("%.2f", "%d") if style == "plugin" else ("%.6f", "%08d")
    line = F.format_string(",".join([frame, "%d", *[digits] * 4, "%.4f" if style == "plugin" else "%.6f", "%d", "%d"]), "frame", F.coalesce("track_id", F.lit(-1)), "x1", "y1", "x2", "y2", "confidence", "class_id", F.col("interpolated").cast("int"))
    _written(rows, line, path, ["frame", "track_id"], "frame,track_id,x1,y1,x2,y2,confidence,class,interpolated" if style == "plugin" else None)


def write_mot(rows: DataFrame, path: str, visibility: float = 1.0) -> None:
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,%d,%.2f", "frame", F.coalesce("track_id", F.lit(-1)), "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.coalesce("confidence", F.lit(-1.0)), F.coalesce("class_id", F.lit(-1)), F.lit(visibility))
    _written(rows, line, path, ["frame", "track_id"], None)


def write_yolo(rows: DataFrame, path: str, width: float, height: float) -> None:
    """Clipped to the picture; boxes under 20 pixels of area are left out."""
    from ..functions import boxes

    b = boxes.clipped(boxes.box(), (0.0, 0.0, width, height))
    cx, cy, w, h = boxes.to_yolo(boxes.box(), width, height)
    _written(rows.where(boxes.area(b) >= 20), F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", cx, cy, w, h), path, ["frame", "row_id"], None)


def write_labelbox(rows: DataFrame, path: str) -> None:
    """One JSON a flight: segments of key frames, height and width each in its place."""
    key = F.struct("frame", F.struct(F.col("x1").alias("left"), F.col("y1").alias("top"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")).alias("bbox"))
    seg = rows.groupBy("flight_id", "track_id").agg(F.array_sort(F.collect_list(key)).alias("keyframes"))
    out = seg.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "keyframes"))).alias("segments"))
    out.select(F.to_json(F.struct("flight_id", "segments")).alias("value")).write.mode("overwrite").text(path)
