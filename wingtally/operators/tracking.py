"""Tracking, track simplification and matching of two cameras: sequential steps, one group a flight."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import tracks
from ..plans import cut
from .assignment import Nearest, Tracker, optimal_edges

_BOX = ["x1", "y1", "x2", "y2"]


def ordered(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, frame, row_id, ..) with each flight in one task, as one sorted stream."""
    return rows.repartition(key).sortWithinPartitions(key, F.col("frame").asc_nulls_last(), F.col("row_id").asc_nulls_last())


def streamed(batches, key: str, begin: Callable):
    """What a flight's step gives for whole frames of ordered rows, batch by batch: begin() gives the step, which takes rows and where each frame begins, and an end, called after the flight's last rows."""
    held, step, end_of, of = None, None, None, None
    for pdf in itertools.chain(batches, [None]):
        rest = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if rest is None or rest.empty:
            continue
        keys = pd.factorize(rest[key], use_na_sentinel=False)[0]
        frames = rest["frame"].to_numpy()
        fresh = np.r_[True, (frames[1:] != frames[:-1]) | (keys[1:] != keys[:-1])]
        end = len(rest) if pdf is None else int(np.flatnonzero(fresh)[-1])  # the last frame may go on
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(keys[:end])) + 1).tolist(), end] if end else []):
            flight = rest[key].iloc[a]
            if step is None or not (flight == of or (pd.isna(flight) and pd.isna(of))):
                if end_of is not None:
                    yield from end_of()
                (step, end_of), of = begin(), flight
            yield from step(rest.iloc[a:b], np.flatnonzero(fresh[a:b]))
        held = rest.iloc[end:]
    if end_of is not None:
        yield from end_of()


def in_order(rows: DataFrame, key: str, step: Callable[[], Callable[[pd.DataFrame, np.ndarray], np.ndarray]]) -> DataFrame:
    """rows (key, frame, row_id, ..) with the track_id that a flight's step gives, frame by frame: step() begins a flight, and takes whole frames and where each begins.

    A flight is one sorted stream in one task, which holds a batch of it and its state, and no flight whole."""
    kind = dict(rows.dtypes)

    def begin():
        now = step()
        return lambda part, starts: [part[[key, "frame", "row_id"]].assign(track_id=now(part, starts))], lambda: []

    return ordered(rows, key).mapInPandas(lambda batches: streamed(batches, key, begin), f"{key} {kind[key]}, frame {kind['frame']}, row_id {kind['row_id']}, track_id long")


def track_boxes(detections: DataFrame, key: str = "flight_id", **how) -> DataFrame:
    """detections (key, frame, row_id, box, class_id) with the track_id that an online tracker gives each; see Tracker for the settings. A flight is read in order of frames in one task."""

    def step():
        tracker = Tracker(**how)

        def run(pdf: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
            boxes, classes = pdf[_BOX].to_numpy(float), pdf["class_id"].to_numpy(int)
            return np.concatenate([tracker.frame(boxes[a:b], classes[a:b]) for a, b in itertools.pairwise([*starts.tolist(), len(pdf)])])

        return run

    return in_order(detections.select(key, "frame", "row_id", *_BOX, "class_id"), key, step)


def track_each(detections: DataFrame, key: str = "flight_id", **how) -> DataFrame:
    """detections (key, frame, row_id, box) with the track_id that each box by itself gets; see Nearest for the settings. A flight is read in order in one task."""

    def step():
        t = Nearest(**how)

        def run(pdf: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
            out, boxes, frames = [], pdf[_BOX].to_numpy(float), pdf["frame"].tolist()
            for a, b in itertools.pairwise([*starts.tolist(), len(pdf)]):
                t.forget(int(frames[a]))
                out += [t.take(int(frames[a]), box) for box in boxes[a:b]]
            return np.array(out)

        return run

    return in_order(detections.select(key, "frame", "row_id", *_BOX), key, step)


def kept_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line Ramer, Douglas and Peucker keep; the last of points equally far."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    work = [(0, len(p) - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        length = float(np.sqrt(d[0] * d[0] + d[1] * d[1]))  # no hypot: points equally far must stay so
        away = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length > 0 else np.sqrt(q[:, 0] * q[:, 0] + q[:, 1] * q[:, 1])
        k = len(away) - 1 - int(away[::-1].argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, tolerance: float, keys: tuple[str, ...] = ("flight_id", "track_id")) -> DataFrame:
    """The rows (keys, frame, x, y) that Ramer, Douglas and Peucker keep of each track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        return pdf[kept_points(pdf[["x", "y"]].to_numpy(float), tolerance)]

    cols = points.select(*keys, "frame", "x", "y")
    return cols.groupBy(*keys).applyInPandas(run, cols.schema)


def assign(cands: DataFrame, key: str = "flight_id") -> DataFrame:
    """candidates that pass their gates (rejected is null) with accepted: in the one-to-one assignment of most pairs and then least distance of their flight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["median_dist", "track_t", "track_w"]).reset_index(drop=True)
        pdf["accepted"] = optimal_edges(pdf["track_t"].to_numpy(), pdf["track_w"].to_numpy(), pdf["median_dist"].to_numpy(float))
        return pdf

    ok = cands.where("rejected is null").drop("rejected")
    return ok.groupBy(key).applyInPandas(run, ok.limit(0).withColumn("accepted", F.lit(True)).schema)


def candidate_groups(cands: DataFrame, rounds: int = 40) -> DataFrame:
    """candidates with `group`: the least track_t that a chain of candidates reaches. Each round takes the least of the partners' groups; its table is cut from its lineage."""
    t = cands.select("track_t").distinct().withColumn("group", F.col("track_t"))
    pairs = cands.select("track_t", "track_w")
    for _ in range(rounds):
        of_w = pairs.join(t, "track_t").groupBy("track_w").agg(F.min("group").alias("g"))
        new = cut(pairs.join(of_w, "track_w").groupBy("track_t").agg(F.min("g").alias("g")).join(t, "track_t").select("track_t", F.least("g", "group").alias("new"), "group"))
        hop = new.select(F.col("track_t").alias("at"), F.col("new").alias("further"))
        settled = new.where(F.col("new") != F.col("group")).isEmpty()
        t = cut(new.join(hop, new["new"] == hop["at"], "left").select("track_t", F.coalesce("further", "new").alias("group")))
        if settled:
            return cands.join(t, "track_t")
    raise RuntimeError(f"groups of candidates have not settled in {rounds} rounds")


def refined_affine(a: DataFrame, b: DataFrame, pairs: DataFrame, start: tuple[float, ...], rounds: int = 5, reach: float = 100.0) -> tuple[tuple[float, ...], float]:
    """Map and its root mean square error after rounds of: nearest partner in each pair of frames under the map (both ways), then least squares over all partners.

    Partners are found and summed in Spark; a map of six numbers comes back each round."""
    l = a.select(F.col("frame").alias("frame_a"), F.col("track_id").alias("t"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    r = b.select(F.col("frame").alias("frame_b"), F.col("track_id").alias("w"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    both = cut(l.join(pairs, "frame_a").join(r, "frame_b"))
    of_a, of_b = (Window.partitionBy("frame_a", "frame_b", c) for c in "tw")
    best, error = start, float("inf")
    for _ in range(rounds):
        m, c, d, e, tx, ty = best
        dx, dy = F.col("ax") * m + F.col("ay") * c + tx - F.col("bx"), F.col("ax") * d + F.col("ay") * e + ty - F.col("by")
        # a pair of frames lies in one task: the nearest of either side are found there, and nothing is dealt out again
        near = both.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(F.col("_d") <= reach).repartition("frame_a", "frame_b")
        near = near.withColumn("_w", F.min(F.struct("_d", "w")).over(of_a)["w"]).withColumn("_t", F.min(F.struct("_d", "t")).over(of_b)["t"])
        passed = Observation()
        chosen = near.where("t = _t and w = _w").observe(passed, F.avg(F.col("_d") * F.col("_d")).alias("square"))
        new = tracks.fit_affine(chosen)  # the error is noted on the way, so that a round deals its pairs once
        square = passed.get["square"]
        now = None if square is None else math.sqrt(square)
        if new is None or now is None or now >= error - 1e-9:
            break
        best, error = new, now
    return best, error


def match_tracks(a: DataFrame, b: DataFrame, pairs: DataFrame, start: tuple[float, ...] | None = None, shared: int = 8, distance: float = 28.0, confidence: float = 0.20) -> DataFrame:
    """Tracks of two cameras matched one to one: a map from frames with one animal each (or a start), refined; candidates under it; gates; assignment, one group of tracks that candidates connect a task."""
    seed = start or tracks.fit_affine(tracks.seed_pairs(a, b, pairs)) or (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    best, _ = refined_affine(a, b, pairs, seed)
    cands = tracks.gate(tracks.candidates(a, b, pairs, best), shared, distance, confidence).where("rejected is null")
    return assign(candidate_groups(cut(cands)), "group").drop("group")
