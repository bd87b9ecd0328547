"""Matching of photos and logs in time, clock offsets, and resampling at given times."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_nearest


def unique_matches(photos: DataFrame, log: DataFrame, most: float, key: str = "flight_id") -> DataFrame:
    """Photos (key, photo_id, t) and log rows (key, log_id, t) one to one within `most` seconds, the nearest pair first; log rows of one time count once.

    Pairs come from time cells of width `most` and their neighbours; a flight's pairs are settled in one task."""
    l = log.withColumn("_r", F.row_number().over(Window.partitionBy(key, "t").orderBy("log_id"))).where("_r = 1").select(key, "log_id", F.col("t").alias("lt"), F.floor(F.col("t") / most).alias("_cell"))
    p = photos.select(key, "photo_id", "t", F.explode(F.array(*[F.floor(F.col("t") / most) + i for i in (-1, 0, 1)])).alias("_cell"))
    pairs = p.join(l, [key, "_cell"]).withColumn("dt", F.abs(F.col("t") - F.col("lt"))).where(F.col("dt") <= most).select(key, "photo_id", "log_id", "dt")
    kind = dict(pairs.dtypes)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dt", "photo_id", "log_id"])
        a, b, keep = set(), set(), []
        for i, (p, q) in enumerate(zip(pdf["photo_id"], pdf["log_id"], strict=True)):
            if p not in a and q not in b:
                a.add(p)
                b.add(q)
                keep.append(i)
        return pdf.iloc[keep]

    return pairs.groupBy(key).applyInPandas(settle, f"{key} {kind[key]}, photo_id {kind['photo_id']}, log_id {kind['log_id']}, dt double")


def nearest_row(rows: DataFrame, times: DataFrame, most: float, key: str = "flight_id") -> DataFrame:
    """For each time (key, at), the id of the row (key, id, t) nearest to it within `most`; the earlier on ties, then the smaller id. One sort of both by key and time."""
    r = rows.groupBy(key, F.col("t").alias("at")).agg(F.min("id").alias("id")).withColumn("row_id", F.col("id"))
    return asof_nearest(times.select(key, "at"), r, key, "at", most, ["id"]).where("near_id is not null").select(key, "at", F.col("near_id").alias("id"))


def index_ranges(rows: DataFrame, ranges: DataFrame, key: str = "flight_id", width: float = 3600.0) -> DataFrame:
    """Time ranges (key, range_id, low, high) as first and last frame in them.

    Time is cut into cells of `width` seconds: a range takes sums of the cells that it holds whole, and meets rows in the cells of its ends alone."""
    cell = lambda c: F.floor(F.col(c) / width)
    r = rows.where("t is not null").select(key, "frame", "t", cell("t").alias("_c"))
    whole = r.groupBy(key, "_c").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    g = ranges.where("low <= high").select(key, "range_id", "low", "high", cell("low").alias("_l"), cell("high").alias("_h"))
    inner = g.where(F.col("_h") - F.col("_l") > 1).select(key, "range_id", F.explode(F.sequence(F.col("_l") + 1, F.col("_h") - 1)).alias("_c")).join(whole, [key, "_c"]).select(key, "range_id", "a", "z")
    ends = g.select("*", F.explode(F.array_distinct(F.array("_l", "_h"))).alias("_c")).join(r, [key, "_c"]).where(F.col("t").between(F.col("low"), F.col("high"))).select(key, "range_id", F.col("frame").alias("a"), F.col("frame").alias("z"))
    return inner.unionByName(ends).groupBy(key, "range_id").agg(F.min("a").alias("start_frame"), F.max("z").alias("end_frame"))


def line_search(f, start: float, step: float, rounds: int = 4000, tol: float = 1e-10) -> tuple[float, float]:
    """simplex of one number, step for step, on plain numbers; no place is looked at twice."""
    known: dict[float, float] = {}

    def at(p: float) -> float:
        if p not in known:
            known[p] = f(p)
        return known[p]

    x, y = start, start + (step if start == 0 else step * max(abs(start), 0.1))
    vx, vy = at(x), at(y)
    for _ in range(rounds):
        if vy < vx or (vx != vx and vy == vy):
            x, y, vx, vy = y, x, vy, vx
        if abs(vy - vx) < tol and abs(y - x) < 1e-8:
            break
        r = x + (x - y)
        vr = at(r)
        if vr < vx:
            e = x + 2.0 * (x - y)
            ve = at(e)
            y, vy = (e, ve) if ve < vr else (r, vr)
            continue
        c = x + (0.5 if vr < vy else -0.5) * (x - y)
        vc = at(c)
        if vc < min(vr, vy):
            y, vy = c, vc
        else:
            y = x + 0.5 * (y - x)
            vy = at(y)
    return [(x, vx), (y, vy)][int(np.argmin([vx, vy]))]


def clock_offset(a: DataFrame, b: DataFrame, key: str = "flight_id") -> DataFrame:
    """The offset in seconds by which a's clock (key, t, lat, lon) is moved to fit b's positions best, and the mean squared error.

    Flights come as one stream sorted by key and time, and a task holds one flight at a time."""
    both = a.select(key, "t", "lat", "lon", F.lit(0).alias("side")).unionByName(b.select(key, "t", "lat", "lon", F.lit(1).alias("side")))

    def flights(batches):
        of, parts = None, []
        for pdf in batches:
            names, codes = pdf[key].tolist(), pd.factorize(pdf[key], use_na_sentinel=False)[0]
            rows = pdf[["t", "lat", "lon", "side"]].to_numpy(float)
            for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(rows)] if len(rows) else []):
                if parts and not (names[i] == of or (pd.isna(names[i]) and pd.isna(of))):
                    yield of, np.concatenate(parts)
                    parts = []
                of = names[i]
                parts.append(rows[i:j])
        if parts:
            yield of, np.concatenate(parts)

    def fitted(rows: np.ndarray) -> tuple[float | None, float | None]:
        (t, lat, lon), (u, to_lat, to_lon) = (np.ascontiguousarray(rows[rows[:, 3] == s, :3].T) for s in (0, 1))
        if not len(t) or not len(u):
            return None, None

        def error(p: float) -> float:
            at = t + p
            return float(((np.interp(at, u, to_lat) - lat) ** 2 + (np.interp(at, u, to_lon) - lon) ** 2).mean() * 1e10)

        best, value = min((line_search(error, s, 1.0) for s in (-5.0, 0.0, 5.0)), key=lambda r: r[1])
        return best, value / 1e10

    def run(batches):
        for some in iter(lambda found=flights(batches): list(itertools.islice(found, 1000)), []):
            yield pd.DataFrame([(of, *fitted(rows)) for of, rows in some], columns=[key, "offset", "error"])

    # small rows, much work: a fixed number of tasks, which adaptive planning doesn't fold into few
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, key).sortWithinPartitions(key, F.col("t").asc_nulls_last())
    return dealt.mapInPandas(run, f"{key} {dict(a.dtypes)[key]}, offset double, error double")


def at_times(telemetry: DataFrame, times: DataFrame, column: str, key: str = "flight_id") -> DataFrame:
    """times (key, at) with the column's linear value there; before the first and after the last row, the end pair's line goes on. One sort of both by key and time; flights of fewer than two rows give nothing."""
    w = Window.partitionBy(key).orderBy("t")
    s = telemetry.select(key, "t", F.col(column).alias("v"))
    s = s.withColumn("t2", F.lead("t").over(w)).withColumn("v2", F.lead("v").over(w)).withColumn("t0", F.lag("t").over(w)).withColumn("v0", F.lag("v").over(w))
    line = F.when(F.col("t2").isNotNull(), F.struct("t", "v", "t2", "v2")).when(F.col("t0").isNotNull(), F.struct(F.col("t0").alias("t"), F.col("v0").alias("v"), F.col("t").alias("t2"), F.col("v").alias("v2")))
    s = s.select(key, F.col("t").alias("_t"), line.alias("_s"), F.lit(0).alias("_side"))
    both = times.select(key, "at").withColumn("_t", F.col("at")).withColumn("_side", F.lit(1)).unionByName(s, allowMissingColumns=True)
    down = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("_l", F.coalesce(F.last("_s", True).over(down), F.last("_s", True).over(up))).where("_side = 1 and _l is not null").select(key, "at", "_l.*")
    return j.select(key, "at", (F.col("v") + (F.col("v2") - F.col("v")) * (F.col("at") - F.col("t")) / F.nullif(F.col("t2") - F.col("t"), F.lit(0.0))).alias(column))
