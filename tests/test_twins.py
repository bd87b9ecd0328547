"""The trackers against a scalar twin on seeded scenes, and estimates against published figures."""

import numpy as np
import pandas as pd
import pytest

from wingtally.operators import estimators, paths, tracking


def scene(seed, frames=40, animals=6):
    """Animals on straight walks; some boxes are missed, some shake, a few belong to nothing."""
    rng = np.random.RandomState(seed)
    at, step, kind, rows = rng.uniform(0, 60, (animals, 2)), rng.normal(0, 0.6, (animals, 2)), rng.randint(0, 2, animals), []
    for f in range(frames):
        at = at + step
        for a in range(animals):
            if rng.rand() >= 0.15:
                c, s = at[a] + rng.normal(0, 0.4, 2), 3 * rng.uniform(0.8, 1.2)
                rows.append((f, *(c - s / 2), *(c + s / 2), kind[a]))
        if rng.rand() < 0.2:
            c = rng.uniform(0, 60, 2)
            rows.append((f, *c, *(c + 2), rng.randint(0, 2)))
    return rows


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return float(np.float32(both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both))) if both else 0.0


def apart(a, b):
    return (((a[0] + a[2]) - (b[0] + b[2])) / 2) ** 2 + (((a[1] + a[3]) - (b[1] + b[3])) / 2) ** 2


def best_of_all(edges, boxes):
    """Most pairs, then least cost, by trying every choice of each box."""

    def go(i, used):
        if i == len(boxes):
            return (0, 0.0, ())
        best = go(i + 1, used)
        for t, v in edges.get(boxes[i], ()):
            if t not in used:
                n, cost, pairs = go(i + 1, used | {t})
                best = min(best, (n - 1, cost + 1 - v, ((boxes[i], t), *pairs)), key=lambda r: (r[0], round(r[1], 9)))
        return best

    return list(go(0, frozenset())[2])


def one_by_one(scored):
    out = []
    for _, d, t in sorted(scored):
        if all(d != x and t != y for x, y in out):
            out.append((d, t))
    return out


def twin(rows, mode, aware, max_age, least=0.3, reach=2.5):
    tracks, ids, count = [], [], 0  # a track: [id, box, class, age]
    for f in sorted({r[0] for r in rows}):
        here = [(r[1:5], r[5]) for r in rows if r[0] == f]
        allowed = lambda d, t: not aware or here[d][1] == tracks[t][2]  # noqa: E731, B023
        pairs = [(d, t) for d in range(len(here)) for t in range(len(tracks)) if allowed(d, t)]
        good = [(overlap(here[d][0], tracks[t][1]), d, t) for d, t in pairs]
        good = [g for g in good if g[0] >= np.float32(least)]
        near = [(apart(here[d][0], tracks[t][1]), d, t) for d, t in pairs]
        near = [n for n in near if n[0] <= reach**2]
        if mode == "greedy":
            found = one_by_one([(-v, d, t) for v, d, t in good])
        elif mode == "center":
            found = one_by_one(near)
        else:
            edges = {}
            for v, d, t in good:
                edges.setdefault(d, []).append((t, v))
            found = best_of_all(edges, sorted(edges))
            if mode == "hungarian_center":
                found += one_by_one([n for n in near if all(n[1] != d and n[2] != t for d, t in found)])
        by_box = dict(found)
        for t, track in enumerate(tracks):
            track[3] += t not in by_box.values()
        new = []
        for d, (box, kind) in enumerate(here):
            if d in by_box:
                tracks[by_box[d]][1], tracks[by_box[d]][3] = box, 0
                ids.append(tracks[by_box[d]][0])
            else:
                count += 1
                new.append([count, box, kind, 0])
                ids.append(count)
        tracks = [t for t in tracks if max_age < 0 or t[3] <= max_age] + new
    return ids


@pytest.mark.parametrize("mode", ["greedy", "hungarian", "center", "hungarian_center"])
def test_trackers_equal_a_scalar_twin(spark, mode):
    scenes = {seed: scene(seed) for seed in (1, 2, 3)}
    rows = [(seed, r[0], i, *map(float, r[1:5]), int(r[5])) for seed, s in scenes.items() for i, r in enumerate(s)]
    boxes = spark.createDataFrame(pd.DataFrame(rows, columns=["flight_id", "frame", "row_id", "x1", "y1", "x2", "y2", "class_id"]))
    for aware, max_age in ((True, -1), (False, 2), (True, 0)):
        out = tracking.track_boxes(boxes, mode=mode, least=0.3, class_aware=aware, max_age=max_age, reach=2.5).toPandas().sort_values(["flight_id", "row_id"])
        for seed, s in scenes.items():
            assert out[out.flight_id == seed].track_id.tolist() == twin(s, mode, aware, max_age), (seed, aware, max_age)


# Counts and areas (ha) of the transects of two surveys with published estimates.
LEMBACH_COUNTS = [0] * 23 + [1, 1, 1, 1, 2, 3, 3, 3, 5, 5]
LEMBACH_AREAS = [
    1.475133, 1.521986, 1.575163, 1.577327, 1.593400, 1.679427, 1.696479, 1.698978, 1.763420, 1.827896, 1.844881, 1.845307, 1.848589, 1.861824, 1.887924, 1.923417, 1.992447,
    2.017391, 2.038991, 2.071418, 2.129862, 2.166071, 2.747946, 1.768878, 1.946804, 2.157280, 2.245080, 2.087712, 1.820423, 1.907402, 2.200424, 2.181985, 2.221030,
]
STSTEFAN_COUNTS = [0] * 26 + [1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 4, 5]
STSTEFAN_AREAS = [
    1.488923, 1.599765, 1.690057, 1.714709, 1.726957, 1.757419, 1.791569, 1.808079, 1.890679, 1.948752, 2.021423, 2.021726, 2.059094, 2.065921, 2.072363, 2.088126, 2.101806, 2.123316, 2.129358, 2.158377,
    2.203595, 2.264995, 2.276287, 2.448357, 2.708561, 2.731780, 1.834966, 1.949574, 1.996594, 2.132053, 2.241751, 2.628096, 2.875178, 1.778265, 1.988550, 2.199333, 2.257071, 2.149337, 2.208404, 1.845604,
]


def test_published_densities(spark):
    rows = [("lembach", c, a) for c, a in zip(LEMBACH_COUNTS, LEMBACH_AREAS)] + [("ststefan", c, a) for c, a in zip(STSTEFAN_COUNTS, STSTEFAN_AREAS)]
    t = spark.createDataFrame(rows, "stratum string, count long, area_ha double")
    got = {r.stratum: r for r in estimators.zinb(t).collect()}
    assert got["lembach"].density == pytest.approx(57.313, rel=1e-3) and got["lembach"].se == pytest.approx(29.847, rel=1e-2) and got["lembach"].error is None
    assert got["ststefan"].density == pytest.approx(32.672, rel=1e-3) and got["ststefan"].se == pytest.approx(2.495, rel=1e-2)
    assert (got["ststefan"].low, got["ststefan"].high) == pytest.approx((27.78, 37.56), abs=0.05)
    naive = {r.stratum: r.naive for r in estimators.population(t, ("naive",)).collect()}
    assert naive["lembach"] == pytest.approx(39.481, rel=1e-4)


def test_gaps_are_filled_to_a_limit(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 0.0), (1, 1, 3, 1, 3.0), (1, 1, 7, 2, 7.0), (1, 1, 7, 3, 8.0), (1, 1, 9, 4, 9.0)], "flight_id long, track_id long, frame long, row_id long, x1 double")
    t = t.selectExpr("*", "x1 as y1", "x1 as x2", "x1 as y2", "0.5D as confidence", "0L as class_id", "10 * x1 as other")
    frames = lambda gap: [r.frame for r in paths.interpolate_tracks(t, max_gap=gap).where("interpolated").orderBy("frame").collect()]
    assert frames(None) == [1, 2, 4, 5, 6, 8] and frames(2) == [1, 2, 8] and frames(0) == []
    got = paths.interpolate_tracks(t, also=("other",)).where("frame = 5").first()
    assert (got.x1, got.other) == (5.0, 50.0)
