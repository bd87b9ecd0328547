"""Readers and writers of poses, corrections, telemetry logs, subtitles and survey files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_XYZ = "array<double>"


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses in either schema: with locations and rotations, or geographic (pitch is then tilt already). The frame is the image's place."""
    image = f"imagefile:string,location:{_XYZ},rotation:{_XYZ},fovy:{_XYZ},lat:double,lng:double,lon:double,alt:double,pitch:double,roll:double,yaw:double,timestamp:string"
    p = spark.read.schema(f"images array<struct<{image}>>").json(path, multiLine=True).select(F.input_file_name().alias("file"), F.exists("images", lambda i: i["location"].isNotNull()).alias("local"), F.posexplode("images").alias("frame", "i"))
    at = lambda a, k: F.get(F.col(f"i.{a}"), F.lit(k))
    turn = lambda k, geo: F.when(F.col("local"), at("rotation", k)).otherwise(F.pmod(F.col(f"i.{geo}"), F.lit(360.0)))
    return p.select("file", F.col("frame").cast("long").alias("frame"), *[at("location", k).alias(n) for k, n in enumerate(("east", "north", "up"))], turn(0, "pitch").alias("tilt"), turn(1, "roll").alias("roll"), turn(2, "yaw").alias("heading"), at("fovy", 0).alias("fovy"), F.col("i.lat").alias("lat"), F.coalesce("i.lng", "i.lon").alias("lon"), F.col("i.alt").alias("alt"), F.try_to_timestamp("i.timestamp").alias("ts"), F.col("i.imagefile").alias("imagefile"))


def write_poses(poses: DataFrame, path: str) -> None:
    """One JSON document a file of poses; what is null is left out."""
    image = F.struct(F.col("imagefile"), F.array("east", "north", "up").alias("location"), F.array("tilt", "roll", "heading").alias("rotation"), F.when(F.col("fovy").isNotNull(), F.array("fovy")).alias("fovy"), F.col("lat"), F.col("lon").alias("lng"))
    images = F.transform(F.array_sort(F.collect_list(F.struct("frame", image.alias("i")))), lambda s: s["i"])
    poses.groupBy("file").agg(images.alias("images")).select(F.to_json(F.struct("images")).alias("value")).write.mode("overwrite").text(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of corrections in any dialect, in the file's order; row 'ord' -1 is the default. A missing end is open, and an empty list counts as absent."""
    v = "struct<x:double,y:double,z:double>"
    r = f"array<struct<`start frame`:long,`end frame`:long,start:long,end:long,start_frame:long,end_frame:long,translation:{v},rotation:{v}>>"
    names = ["additional", "additional_corrections", "corrections", "fine_corrections"]
    c = spark.read.schema(f"translation {v}, rotation {v}, {', '.join(f'{n} {r}' for n in names)}").json(path, multiLine=True)
    ranges = F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names])
    out = c.select(F.input_file_name().alias("file"), F.col("translation").alias("t0"), F.col("rotation").alias("r0"), F.posexplode_outer(ranges).alias("ord", "c"))
    own = lambda s, a: F.coalesce(F.col(f"c.{s}.{a}"), F.col(f"{s[0]}0.{a}"), F.lit(0.0)).alias(f"{s[0]}{a}")
    both = [own(s, a) for s in ("translation", "rotation") for a in "xyz"]
    rows = out.where("c is not null").select("file", F.col("ord").cast("int").alias("ord"), F.coalesce("c.start frame", "c.start", "c.start_frame", F.lit(0).cast("long")).alias("start_frame"), F.coalesce("c.end frame", "c.end", "c.end_frame").alias("end_frame"), *both)
    default = out.groupBy("file").agg(*[F.first(F.coalesce(F.col(f"{s}0.{a}"), F.lit(0.0))).alias(f"{s}{a}") for s in "tr" for a in "xyz"])
    return rows.unionByName(default.withColumn("ord", F.lit(-1)).withColumn("start_frame", F.lit(0).cast("long")).withColumn("end_frame", F.lit(None).cast("long")))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header of names and units. Units go from the names; feet and miles an hour become metres and kilometres an hour; cells that are no numbers are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    cols, seen = [], set()
    for name in raw.columns:
        bare, _, unit = name.strip().partition("(")
        bare, unit = bare.strip(), unit.rstrip(") ").lower()
        if not bare or bare in seen:
            continue
        seen.add(bare)
        c, text = F.col(f"`{name}`"), F.trim(F.col(f"`{name}`"))
        if bare.startswith("datetime"):
            cols.append(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"))
            continue
        n = F.expr(f"try_cast(trim(`{name}`) as double)")
        if unit == "feet":
            n = n / 3.28
        elif unit == "mph":
            n = n * 1.6093
        cols.append((c if bare in ("flycState", "message") else n).alias(bare))
    return raw.select(F.input_file_name().alias("file"), *cols)


_TAG = r"\[([A-Za-z_]+)\s*:?\s*([^\]]*)\]"


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Records of a drone's subtitle file: id from 0, times in ms, the time stamp, and `meta`, a map of lower-case keys. `[k: a, s: b]` gives k and k_s."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.split("value", r"\r?\n\s*\r?\n")).alias("b")).where(F.trim("b") != "")
    ms = lambda g: sum((F.regexp_extract("b", r"(\d+):(\d+):(\d+),(\d+)\s*-->\s*(\d+):(\d+):(\d+),(\d+)", g + i).cast("long") * f for i, f in enumerate((3_600_000, 60_000, 1000, 1))), F.lit(0))
    ok = blocks.where(F.col("b").rlike(r"\d+:\d+:\d+,\d+\s*-->"))
    tags = F.regexp_extract_all("b", F.lit(r"\[([^\]]*)\]"), F.lit(1))
    pairs = F.flatten(F.transform(tags, _pairs))
    return ok.select(
        "file", (F.expr("try_cast(regexp_extract(b, '^\\\\s*([0-9]+)', 1) as long)") - 1).alias("id"), ms(1).alias("start_ms"), ms(5).alias("end_ms"),
        F.try_to_timestamp(F.substring(F.regexp_replace(F.regexp_extract("b", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[.,]?\d*)", 1), ",", "."), 1, 23)).alias("ts"),
        F.expr("try_cast(regexp_extract(b, 'DiffTime *: *([0-9]+)', 1) as long)").alias("diff_ms"), F.map_from_entries(F.array_distinct(pairs)).alias("meta"),
    )


def _pairs(tag):
    """The entries of one tag; the known misspelling of longitude is put right."""
    parts = F.split(tag, ",")
    first = F.lower(F.trim(F.substring_index(F.get(parts, F.lit(0)), ":", 1)))

    def entry(p, i):
        k = F.lower(F.trim(F.substring_index(p, ":", 1)))
        k = F.when(i == 0, k).otherwise(F.concat(first, F.lit("_"), k))
        return F.struct(F.regexp_replace(k, "longtitude", "longitude").alias("key"), F.trim(F.substring_index(p, ":", -1)).alias("value"))

    several = F.regexp_extract_all(tag, F.lit(r"([A-Za-z_]+)\s*:\s*([^\s,:\]]+)"), F.lit(0))
    spaced = F.transform(several, lambda s: F.struct(F.regexp_replace(F.lower(F.trim(F.substring_index(s, ":", 1))), "longtitude", "longitude").alias("key"), F.trim(F.substring_index(s, ":", -1)).alias("value")))
    return F.when(F.contains(tag, F.lit(",")), F.transform(parts, entry)).otherwise(spaced)


def read_route(spark: SparkSession, path: str) -> DataFrame:
    """The first line of a feature collection as rows frame, x, y; without a line, its first point."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("features").alias("pos", "f")).select("file", "pos", "f.geometry.*").where("type in ('LineString', 'Point')")
    best = f.groupBy("file").agg(F.min(F.struct((F.col("type") == "Point").cast("int").alias("rank"), "pos", "type", "coordinates")).alias("g"))
    line = F.when(F.col("g.type") == "Point", F.array(F.from_json("g.coordinates", "array<double>"))).otherwise(F.from_json("g.coordinates", "array<array<double>>"))
    return best.select("file", F.posexplode(line).alias("frame", "p")).select("file", F.col("frame").cast("long").alias("frame"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def write_route(route: DataFrame, path: str, epsg: int, name: str = "flight_route") -> None:
    """A feature collection with one line of a flight's positions in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(name).alias("name"), F.col("flight_id")).alias("properties"), geometry.alias("geometry"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{epsg}").alias("name")).alias("properties"))
    route.groupBy("flight_id").agg(line.alias("line")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.array(feature).alias("features"))).alias("value")).write.mode("overwrite").text(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """`frame n x1 y1 z1 ...` as frame and ring; n of 0 is an empty ring, and rows too short for their n are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("c"))
    n = F.expr("try_cast(get(c, 1) as int)")
    ok = lines.withColumn("n", n).where((F.col("n") >= 0) & (F.size("c") >= 2 + 3 * F.col("n")))
    at = lambda i, k: F.get("c", 2 + 3 * i + k).cast("double")
    ring = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))).otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>"))
    return ok.select("file", F.expr("try_cast(get(c, 0) as long)").alias("frame"), ring.alias("ring")).where("frame is not null")


def write_polygons(polygons: DataFrame, path: str) -> None:
    """Rings by frame; corners that are null or no numbers are left out."""
    ok = F.filter("ring", lambda p: p["x"].isNotNull() & ~F.isnan(p["x"]))
    text = F.transform(ok, lambda p: F.format_string("%.6f %.6f %.6f", p["x"], p["y"], p["z"]))
    polygons.orderBy("frame").select(F.concat_ws(" ", F.col("frame").cast("string"), F.size(ok).cast("string"), F.array_join(text, " ")).alias("value")).select(F.trim("value").alias("value")).write.mode("overwrite").text(path)


def read_transects(spark: SparkSession, path: str) -> DataFrame:
    schema = "transects array<struct<id:long,name:string,start_frame:long,end_frame:long,length_m:double>>"
    t = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("transects").alias("pos", "t"))
    return t.select("file", F.coalesce("t.id", F.col("pos").cast("long")).alias("transect_id"), "t.name", "t.start_frame", "t.end_frame", "t.length_m")


def parsed_names(files: DataFrame, column: str = "file") -> DataFrame:
    """files with what their names tell: flight_id before the first '_', the last run of digits, and the camera's time stamp."""
    name = F.regexp_extract(column, r"([^/]*)$", 1)
    digits = F.regexp_extract_all(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(r"(\d+)"), F.lit(1))
    return files.withColumn("flight_name", F.substring_index(name, "_", 1)).withColumn("frame_index", F.try_element_at(digits, F.lit(-1)).try_cast("long")).withColumn("taken_at", F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{14})_", 1), F.lit("")), F.lit("yyyyMMddHHmmss")))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """file, mtx (3 x 3) and dist (5 zeros if missing; nested or flat) of a camera's JSON."""
    c = spark.read.schema("mtx array<array<double>>, dist string").json(path, multiLine=True).select(F.input_file_name().alias("file"), "mtx", "dist")
    flat = F.from_json(F.concat(F.lit("["), F.regexp_replace("dist", r"[\[\]\s]", ""), F.lit("]")), "array<double>")
    return c.select("file", "mtx", F.coalesce(flat, F.array(*[F.lit(0.0)] * 5)).alias("dist"))


def read_perpendicular(spark: SparkSession, path: str) -> DataFrame:
    """frame, centre (x, y, z), foot (x, y), distance and class of either layout: `perpendiculas`, or `tracks` with a last_frame."""
    row = "frame:long,last_frame:long,detection_center:array<double>,foot_point:array<double>,distance_m:double,class_id:long"
    d = spark.read.schema(f"perpendiculas array<struct<{row}>>, tracks array<struct<{row}>>").json(path, multiLine=True)
    rows = F.when(F.size("perpendiculas") > 0, F.col("perpendiculas")).otherwise(F.col("tracks"))
    r = d.select(F.input_file_name().alias("file"), F.posexplode(rows).alias("row_id", "r"))
    at = lambda c, i: F.get(F.col(f"r.{c}"), F.lit(i))
    return r.select(
        "file", "row_id", F.coalesce("r.frame", "r.last_frame", F.lit(-1).cast("long")).alias("frame"), *[at("detection_center", i).alias(n) for i, n in enumerate(("x", "y", "z"))],
        at("foot_point", 0).alias("foot_x"), at("foot_point", 1).alias("foot_y"), F.col("r.distance_m").alias("distance"), F.coalesce("r.class_id", F.lit(0).cast("long")).alias("class_id"),
    )


def start_and_end(log: DataFrame, key: str = "file", order: str = "row_id") -> DataFrame:
    """Per log the time of its first and its last row; logs of fewer than two rows are left out."""
    g = log.groupBy(key).agg(F.min_by("ts", order).alias("start"), F.max_by("ts", order).alias("end"), F.count("*").alias("_n"))
    return g.where("_n > 1").drop("_n")


def relative_folder(parent: str, path: Column, is_file: bool = True) -> Column:
    """The folder of a path below the parent, '' for the parent itself; null for paths elsewhere."""
    folder = F.regexp_replace(path, "/[^/]*$", "") if is_file else F.rtrim(path, F.lit("/"))
    base = parent.rstrip("/")
    return F.when(folder == base, "").when(F.startswith(folder, F.lit(base + "/")), F.substr(folder, F.lit(len(base) + 2)))


def write_points(points: DataFrame, path: str, epsg: int, name: str = "camera_positions") -> None:
    """A feature collection with a point for each row (x, y), in order of frame; all other columns are its properties. A flight is one line."""
    rest = [c for c in points.columns if c not in ("flight_id", "x", "y")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("frame", feature.alias("f")))), lambda s: s["f"])
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{epsg}").alias("name")).alias("properties"))
    out = points.groupBy("flight_id").agg(all_of.alias("features"))
    out.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(name).alias("name"), crs.alias("crs"), "features")).alias("value")).write.text(path)
