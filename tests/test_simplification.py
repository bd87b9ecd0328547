"""Lines simplified level by level keep what the plain method keeps."""

import math
import random

import numpy as np
import pandas as pd

from wingtally.operators import simplification, tracking


def walk(seed, n):
    rng = np.random.RandomState(seed)
    turn = np.cumsum(rng.normal(0, 0.2, n))
    return np.cumsum(np.cos(turn)), np.cumsum(np.sin(turn))


def table(lines):
    return pd.concat([pd.DataFrame({"flight_id": k, "track_id": 1, "frame": np.arange(len(x)), "x": x, "y": y}) for k, (x, y) in lines.items()])


def test_levels_keep_the_same_points(spark):
    circle = [2 * math.pi * i / 300 for i in range(301)]
    lines = {1: walk(1, 900), 2: walk(2, 700), 3: (np.arange(50.0), np.zeros(50)), 4: (np.array([1.0]), np.array([2.0])), 5: (np.array([1.0, 1.0]), np.array([2.0, 2.0])), 6: (np.cos(circle) * 50, np.sin(circle) * 50), 7: (np.zeros(40), np.zeros(40))}
    rows = table(lines).sample(frac=1.0, random_state=3)
    d = spark.createDataFrame(rows)
    for tolerance in (0.5, 4.0):
        got = sorted(map(tuple, simplification.simplify_long(d, tolerance, small=30).select("flight_id", "frame").collect()))
        want = sorted((k, int(f)) for k, (x, y) in lines.items() for f in np.flatnonzero(tracking.kept_points(np.stack([x, y], 1), tolerance)))
        assert got == [w for w in want]
    none = simplification.simplify_long(d.where("false"), 1.0, small=30)
    assert none.count() == 0 and none.columns == ["flight_id", "track_id", "frame", "x", "y"]


def test_a_long_line_is_many_groups(spark):
    x, y = walk(9, 120_000)
    got = simplification.simplify_long(spark.createDataFrame(table({1: (x, y)})), 25.0, small=8000)
    assert sorted(r.frame for r in got.select("frame").collect()) == np.flatnonzero(tracking.kept_points(np.stack([x, y], 1), 25.0)).tolist()


def test_repeated_frames_and_missing_places(spark):
    rng = random.Random(1)
    rows = [(1, 1, i // 2, float(i), rng.uniform(0, 9)) for i in range(200)] + [(1, 1, 5, None, 1.0)]
    d = spark.createDataFrame(rows, "flight_id long, track_id long, frame long, x double, y double")
    line = sorted((f, x, y) for _, _, f, x, y in rows if x is not None)
    keep = tracking.kept_points(np.array([p[1:] for p in line]), 3.0)
    got = sorted((r.frame, r.x, r.y) for r in simplification.simplify_long(d, 3.0, small=20).collect())
    assert got == [p for p, k in zip(line, keep) if k]


def test_of_points_equally_far_the_last_is_kept(spark):
    line = np.array([(0, 0), (1, 3), (4, 3), (10, 0)], float)
    assert np.flatnonzero(tracking.kept_points(line, 2.0)).tolist() == [0, 2, 3]
    d = spark.createDataFrame(table({1: (line[:, 0], line[:, 1])}))
    for small in (1, 50):
        assert sorted(r.frame for r in simplification.simplify_long(d, 2.0, small=small).select("frame").collect()) == [0, 2, 3]
