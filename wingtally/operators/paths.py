"""Ordered analytics over frames of a flight: lengths, gaps, resampling, smoothing, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLIGHT = "flight_id"


def _order(key: str = FLIGHT, by: str = "frame"):
    return Window.partitionBy(key).orderBy(by)


def cumulative_distances(route: DataFrame, key: str = FLIGHT) -> DataFrame:
    """route with cum: path length so far; a row without a position adds nothing and inherits."""
    before = _order(key).rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.last(F.when(ok, F.col("x")), True).over(before), F.last(F.when(ok, F.col("y")), True).over(before)
    dx, dy = F.col("x") - px, F.col("y") - py
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return route.withColumn("step", step).withColumn("cum", F.sum("step").over(_order(key).rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def route_length(route: DataFrame, key: str = FLIGHT) -> DataFrame:
    return cumulative_distances(route, key).groupBy(key).agg(F.max("cum").alias("length"))


def transect_lengths(cum: DataFrame, ranges: DataFrame, key: str = FLIGHT) -> DataFrame:
    """ranges (key, transect_id, start_frame, end_frame) with length: |cum(end) - cum(start)|, frames clamped to the flight's.

    One pass over cum: a range is short of frames of its own flight only, so an equi join on the flight meets it."""
    last = cum.groupBy(key).agg(F.max("frame").alias("_last"))
    r = ranges.join(last, key).withColumn("_a", F.greatest(F.lit(0), F.least("start_frame", "_last"))).withColumn("_b", F.greatest(F.lit(0), F.least("end_frame", "_last")))
    at = cum.select(key, F.col("frame").alias("_f"), F.col("cum").alias("_c"))
    ends = r.withColumn("_f", F.explode(F.array("_a", "_b"))).join(at, [key, "_f"]).groupBy(*ranges.columns).agg(F.abs(F.max("_c") - F.min("_c")).alias("length"))
    return ends


def frame_after_distance(cum: DataFrame, starts: DataFrame, key: str = FLIGHT) -> DataFrame:
    """starts (key, start_frame, metres) with frame: the first at which the path is metres longer than at the start, else -1."""
    at = cum.select(key, F.col("frame").alias("start_frame"), F.col("cum").alias("_c"))
    r = starts.join(at, [key, "start_frame"])
    hit = r.join(cum.select(key, "frame", "cum"), key).where(F.col("cum") >= F.col("_c") + F.col("metres"))
    first = hit.groupBy(*starts.columns).agg(F.min("frame").alias("frame"))
    return starts.join(first, starts.columns, "left").withColumn("frame", F.coalesce("frame", F.lit(-1).cast("long")))


def split_into(cum: DataFrame, n: int, key: str = FLIGHT) -> DataFrame:
    """n stretches of equal length of each flight: transect_id from 0, start_frame, end_frame."""
    total = cum.groupBy(key).agg(F.max("cum").alias("_t"), F.max("frame").alias("_last"))
    edges = total.withColumn("transect_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_edge", F.col("_t") * F.col("transect_id") / n)
    inner = edges.where("transect_id > 0").join(cum.select(key, "frame", "cum"), key).where("cum >= _edge").groupBy(key, "transect_id").agg(F.min("frame").alias("start_frame"))
    out = edges.join(inner, [key, "transect_id"], "left").withColumn("start_frame", F.coalesce("start_frame", F.lit(0).cast("long")))
    following = F.lead("start_frame").over(Window.partitionBy(key).orderBy("transect_id"))
    return out.withColumn("end_frame", F.greatest(F.coalesce(following - 1, F.col("_last")), F.col("start_frame"))).select(key, "transect_id", "start_frame", "end_frame")


def split_by_distance(cum: DataFrame, metres: float, key: str = FLIGHT) -> DataFrame:
    """Consecutive stretches of at least `metres`, each from the frame after the last: a cut depends on the one before, so a flight is cut in one task."""
    import pandas as pd

    kind = dict(cum.dtypes)[key]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        c, f = pdf["cum"].to_numpy(), pdf["frame"].to_numpy()
        rows, a = [], 0
        while a < len(c):
            b = int(c.searchsorted(c[a] + metres, "left"))
            b = min(b, len(c) - 1)
            rows.append((pdf[key].iloc[0], len(rows), f[a], f[b]))
            a = b + 1
        return pd.DataFrame(rows, columns=[key, "transect_id", "start_frame", "end_frame"])

    return cum.select(key, "frame", "cum").groupBy(key).applyInPandas(cut, f"{key} {kind}, transect_id int, start_frame long, end_frame long")


def centre_line(route: DataFrame, ranges: DataFrame, key: str = FLIGHT) -> DataFrame:
    """The positions in each range, in order, as an array of points."""
    r = route.where("x is not null and y is not null").select(key, "frame", "x", "y")
    inside = ranges.join(r, key).where(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    points = F.array_sort(F.collect_list(F.struct("frame", "x", "y")))
    return inside.groupBy(*ranges.columns).agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def interpolate_tracks(tracks: DataFrame, confidence: str = "mean", keys: tuple[str, ...] = (FLIGHT, "track_id"), max_gap: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """tracks with a row for each frame between a track's rows, flagged interpolated.

    'mean': confidence is the mean of both ends, class that of the later; 'linear': confidence between, class of the earlier.
    max_gap: the most frames that may be missing between two rows for them to be filled in; None fills every gap, so that the
    rows that come out follow the frames that tracks span and not the rows that go in. also: further columns that are linear between ends."""
    w = Window.partitionBy(*keys).orderBy("frame", "row_id")
    line = ["x1", "y1", "x2", "y2", *also]
    paired = tracks.select("*", *[F.lead(n).over(w).alias(f"_{n}") for n in (*line, "confidence", "class_id", "frame")])
    missing = F.col("_frame") - F.col("frame") - 1
    gaps = paired.where((missing >= 1) & ((missing <= max_gap) if max_gap is not None else F.lit(True)))
    gaps = gaps.withColumn("_at", F.explode(F.sequence(F.col("frame") + 1, F.col("_frame") - 1)))
    t = (F.col("_at") - F.col("frame")) / (F.col("_frame") - F.col("frame"))
    lerp = lambda n: F.col(n) + (F.col(f"_{n}") - F.col(n)) * t
    conf = (F.col("confidence") + F.col("_confidence")) / 2 if confidence == "mean" else lerp("confidence")
    filled = gaps.select(*keys, F.col("_at").alias("frame"), F.lit(None).cast("long").alias("row_id"), *(lerp(n).alias(n) for n in line), conf.alias("confidence"), F.col("_class_id" if confidence == "mean" else "class_id").alias("class_id"), F.lit(True).alias("interpolated"))
    own = tracks.select(*keys, "frame", "row_id", *line, "confidence", "class_id", F.lit(False).alias("interpolated"))
    return own.unionByName(filled)


def unwrapped(angle: str, w) -> Column:
    """Angle without jumps at 360: each step is the short way round."""
    step = F.col(angle) - F.lag(angle).over(w)
    return F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum(F.coalesce(step - 360 * F.round(step / 360), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def resample(telemetry: DataFrame, seconds: float, columns: list[str], angles: tuple[str, ...] = (), key: str = FLIGHT) -> DataFrame:
    """Rows at every whole multiple of `seconds`, linear between a flight's neighbours; angles turn the short way."""
    w = Window.partitionBy(key).orderBy("t")
    p = telemetry.withColumn("_t", F.lead("t").over(w))
    for c in [*columns, *angles]:
        p = p.withColumn(f"_{c}", F.lead(c).over(w))
    p = p.where(F.col("_t") > F.col("t")).withColumn("_i", F.ceil(F.col("t") / seconds)).withColumn("_j", F.ceil(F.col("_t") / seconds) - 1).where("_i <= _j")
    p = p.withColumn("tick", F.explode(F.sequence("_i", "_j")))
    s = (F.col("tick") * seconds - F.col("t")) / (F.col("_t") - F.col("t"))
    line = [(F.col(c) + (F.col(f"_{c}") - F.col(c)) * s).alias(c) for c in columns]
    turn = [F.pmod(F.col(c) + (F.pmod(F.col(f"_{c}") - F.col(c) + 180, F.lit(360.0)) - 180) * s, F.lit(360.0)).alias(c) for c in angles]
    return p.select(key, "tick", *line, *turn)


def spread_seconds(rows: DataFrame, key: str = FLIGHT, second: str = "second", by: str = "id") -> DataFrame:
    """rows with share: of k rows in one second, the i-th is i / k of it further on."""
    w = Window.partitionBy(key, second)
    return rows.withColumn("share", (F.row_number().over(w.orderBy(by)) - 1) / F.count("*").over(w))


def without_repeats(rows: DataFrame, value: str, key: str = FLIGHT, by: str = "frame") -> DataFrame:
    """rows without those whose value is that of the row before."""
    return rows.withColumn("_p", F.lag(value).over(_order(key, by))).withColumn("_n", F.row_number().over(_order(key, by))).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def moving_average(route: DataFrame, columns: list[str], size: int = 11, key: str = FLIGHT) -> DataFrame:
    """route with the centred mean over an odd number of rows; the first and last rows stand for what is missing."""
    k = size // 2
    w, whole = _order(key), Window.partitionBy(key)
    out = route.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in columns:
        inside = F.sum(c).over(w.rowsBetween(-k, k))
        left, right = F.greatest(F.lit(0), k - F.col("_i")), F.greatest(F.lit(0), k - (F.col("_n") - 1 - F.col("_i")))
        out = out.withColumn(f"{c}_smooth", (inside + left * F.first(c).over(ends) + right * F.last(c).over(ends)) / (2 * k + 1))
    return out.drop("_i", "_n")


def savitzky_golay(route: DataFrame, columns: list[str], size: int = 11, degree: int = 2, key: str = FLIGHT) -> DataFrame:
    """route with each column fitted by a polynomial over a window; at the ends, by that of the end window. A flight is one group."""
    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        n = min(size, len(pdf) if len(pdf) % 2 else len(pdf) - 1)
        for c in columns:
            v = pdf[c].to_numpy(float)
            out = v.copy()
            if n > degree:
                x = np.arange(n) - n // 2
                hat = np.vander(x, degree + 1) @ np.linalg.pinv(np.vander(x, degree + 1))
                k = n // 2
                out[k : len(v) - k] = np.lib.stride_tricks.sliding_window_view(v, n) @ hat[k]
                out[:k], out[len(v) - k :] = (hat @ v[:n])[:k], (hat @ v[-n:])[n - k :]
            pdf[f"{c}_smooth"] = out
        return pdf

    schema = route.limit(0).select("*", *(F.lit(0.0).alias(f"{c}_smooth") for c in columns)).schema
    return route.groupBy(key).applyInPandas(fit, schema)


def heading_from_path(route: DataFrame, key: str = FLIGHT) -> DataFrame:
    """route with course: degrees from each frame to the next (the last takes the pair before), 0 for steps under 1 mm."""
    w = _order(key)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    out = route.withColumn("_dx", F.coalesce(dx, F.col("x") - F.lag("x").over(w), F.lit(0.0))).withColumn("_dy", F.coalesce(dy, F.col("y") - F.lag("y").over(w), F.lit(0.0)))
    far = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) >= 1e-3
    return out.withColumn("course", F.when(far, F.pmod(F.degrees(F.atan2("_dx", "_dy")), F.lit(360.0))).otherwise(0.0)).drop("_dx", "_dy")


def islands(rows: DataFrame, flag: str, key: str = FLIGHT, by: str = "frame") -> DataFrame:
    """rows with island: the number of the run of equal flags that a row is in."""
    w = _order(key, by)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def first_run(rows: DataFrame, flag: str, key: str = FLIGHT, by: str = "frame") -> DataFrame:
    """The rows of each flight's first run in which the flag is 1."""
    runs = islands(rows, flag, key, by).where(F.col(flag) == 1)
    return runs.withColumn("_f", F.min("island").over(Window.partitionBy(key))).where("island = _f").drop("_f", "island")


def neighbours(frames: DataFrame, reach: int = 100, step: int = 10, key: str = FLIGHT) -> DataFrame:
    """For each central frame, the frames at every step within reach that exist."""
    offsets = [o for o in range(-reach, reach + 1, step) if o]
    asked = frames.select(key, F.col("frame").alias("central"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("frame", F.col("central") + F.col("offset"))
    return asked.join(frames.select(key, "frame"), [key, "frame"])


def every_nth(rows: DataFrame, skip: int = 0, stride: int = 1, limit: int | None = None, key: str = FLIGHT, by: str = "frame") -> DataFrame:
    """Skip, then every stride-th row, then at most limit rows of each flight."""
    out = rows.withColumn("_i", F.row_number().over(_order(key, by)) - 1 - skip).where((F.col("_i") >= 0) & (F.col("_i") % stride == 0))
    return (out if limit is None else out.where(F.col("_i") < limit * stride)).drop("_i")


def concatenated(files: DataFrame) -> DataFrame:
    """Rows (file_no, id, start_ms, end_ms) with ids and times that go on from file to file."""
    ends = files.groupBy("file_no").agg(F.max("end_ms").alias("_e"))
    base = ends.withColumn("_base", F.coalesce(F.sum("_e").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_e")
    n = files.groupBy("file_no").agg(F.count("*").alias("_m"))
    n = n.withColumn("_first", F.coalesce(F.sum("_m").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    out = files.join(base, "file_no").join(n, "file_no")
    out = out.withColumn("id", F.col("_first") + F.row_number().over(Window.partitionBy("file_no").orderBy("start_ms", "id")) - 1)
    return out.withColumn("start_ms", F.col("start_ms") + F.col("_base")).withColumn("end_ms", F.col("end_ms") + F.col("_base")).drop("_base", "_first")
