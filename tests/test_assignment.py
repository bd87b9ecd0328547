import time

import numpy as np
from pyspark.sql import functions as F

from wingtally.operators.assignment import optimal, optimal_edges
from wingtally.operators.tracking import assign


def dense(i, j, d, n, m):
    cost = np.full((n, m), 1e6)
    np.minimum.at(cost, (i, j), d)
    pairs = [(a, b) for a, b in optimal(cost) if cost[a, b] < 1e6]
    return len(pairs), sum(cost[a, b] for a, b in pairs)


def test_equals_the_dense_solver_on_random_graphs():
    rng = np.random.RandomState(0)
    for _ in range(400):
        n, m = rng.randint(1, 14, 2)
        e = rng.randint(1, n * m + 1) if rng.rand() < 0.5 else rng.randint(1, n + m + 1)
        i, j = rng.randint(0, n, e), rng.randint(0, m, e)
        d = rng.randint(0, 6, e).astype(float) if rng.rand() < 0.3 else rng.rand(e) * 28
        chosen = optimal_edges(i, j, d)
        assert len(set(i[chosen])) == len(set(j[chosen])) == chosen.sum()
        size, total = dense(i, j, d, n, m)
        assert chosen.sum() == size and abs(d[chosen].sum() - total) < 1e-6


def test_empty_repeats_and_one_edge():
    none = np.zeros(0)
    assert not len(optimal_edges(none, none, none))
    assert optimal_edges(np.array([5, 5]), np.array([7, 7]), np.array([1.0, 1.0])).tolist() == [True, False]
    assert optimal_edges(np.array([5, 5]), np.array([7, 7]), np.array([2.0, 1.0])).tolist() == [False, True]


def test_one_large_component_is_held_by_its_edges(spark):
    rng = np.random.RandomState(1)
    n = 10_000  # a dense matrix would take 800 MB
    i = np.repeat(np.arange(n), 5)
    j = (i + rng.randint(-20, 21, len(i))) % n
    cands = spark.createDataFrame(np.c_[i, j].tolist(), "track_t long, track_w long").distinct().select(F.lit(1).alias("flight_id"), "track_t", "track_w", (F.abs(F.hash("track_t", "track_w")) % 2800 / 100.0).alias("median_dist"), F.lit(None).cast("string").alias("rejected"))
    begin = time.time()
    got = assign(cands).where("accepted").agg(F.count("*"), F.countDistinct("track_t"), F.countDistinct("track_w")).first()
    assert got[0] == got[1] == got[2] > 0.95 * n
    assert time.time() - begin < 120
