"""The tracker with a motion model against a scalar twin with whole matrices."""

import numpy as np
import pandas as pd

from wingtally.operators import motion

from .test_twins import best_of_all, overlap


class Filter:
    """One box's Kalman filter by 8 x 8 matrices."""

    def __init__(self, box):
        self.x = np.r_[self.seen(box), np.zeros(4)]
        h = self.x[3]
        self.p = np.diag(np.square([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]))

    @staticmethod
    def seen(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return np.array([b[0] + w / 2, b[1] + h / 2, w / h, h])

    def predict(self):
        h, f = self.x[3], np.eye(8) + np.eye(8, k=4)
        q = np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]))
        self.x, self.p = f @ self.x, f @ self.p @ f.T + q

    def update(self, box):
        h, m = self.x[3], np.eye(4, 8)
        s = m @ self.p @ m.T + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
        k = self.p @ m.T @ np.linalg.inv(s)
        self.x, self.p = self.x + k @ (self.seen(box) - m @ self.x), self.p - k @ s @ k.T

    def box(self):
        x, y, a, h = self.x[:4]
        return (x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2)


def twin(rows, patience=30):
    """rows: (frame, box, confidence) in order; track numbers, 0 for none."""
    ids, tracks, count, last = [0] * len(rows), [], 0, None
    for f in sorted({r[0] for r in rows}):
        here = [i for i, r in enumerate(rows) if r[0] == f]
        for t in tracks:
            if t["state"] == "lost":
                t["filter"].x[7] = 0
            for _ in range(min(f - last, patience + 1)):
                t["filter"].predict()
        tracks = [t for t in tracks if f - t["seen"] <= patience]
        used, met, pairs = set(), set(), []
        for states, sure, limit in (({"seen", "lost"}, True, 0.8), ({"seen"}, False, 0.5), ({"new"}, True, 0.7)):
            boxes = [i for i in here if i not in used and (rows[i][2] >= 0.5 if sure else 0.1 <= rows[i][2] < 0.5)]
            edges = {}
            for i in boxes:
                for k, t in enumerate(tracks):
                    if t["state"] in states and k not in met:
                        v = overlap(rows[i][1], t["filter"].box())
                        if 1 - v <= limit:
                            edges.setdefault(i, []).append((k, v))
            now = best_of_all(edges, sorted(edges))
            used |= {i for i, _ in now}
            met |= {k for _, k in now}
            pairs += now
        for i, k in sorted(pairs):
            t = tracks[k]
            if t["state"] == "new":
                count += 1
                t["id"] = ids[t["first"]] = count
            ids[i] = t["id"]
            t["filter"].update(rows[i][1])
            t["state"], t["seen"] = "seen", f
        for k, t in enumerate(tracks):
            if k not in met and t["state"] == "seen":
                t["state"] = "lost"
        tracks = [t for k, t in enumerate(tracks) if k in met or t["state"] == "lost"]
        for i in here:
            if i not in used and rows[i][2] >= 0.6:
                count += last is None
                ids[i] = count if last is None else 0
                tracks.append({"filter": Filter(rows[i][1]), "state": "seen" if last is None else "new", "seen": f, "id": ids[i], "first": i})
        last = f
    return ids


def scene(seed):
    rng = np.random.RandomState(seed)
    at, step, out = rng.uniform(0, 60, (6, 2)), rng.normal(0, 0.8, (6, 2)), []
    for f in range(60):
        at = at + step
        if f in (20, 21):
            continue  # nobody looks
        for a in range(6):
            if rng.rand() >= 0.15 and not (a == 0 and 25 < f < 40) and not (a == 1 and f > 22):
                c, s = at[a] + rng.normal(0, 0.3, 2), 4 * rng.uniform(0.9, 1.1, 2)
                out.append((f, tuple(map(float, [*(c - s / 2), *(c + s / 2)])), float(rng.choice([0.05, 0.3, 0.45, 0.55, 0.7, 0.9], p=[0.05, 0.1, 0.1, 0.1, 0.15, 0.5]))))
        if rng.rand() < 0.2:
            c = rng.uniform(0, 60, 2)
            out.append((f, tuple(map(float, [*c, *(c + 3)])), 0.8))
    return out


def test_it_equals_a_scalar_twin(spark):
    scenes = {seed: scene(seed) for seed in range(1, 7)}
    rows = [(k, f, i, *b, c) for k, s in scenes.items() for i, (f, b, c) in enumerate(s)]
    boxes = spark.createDataFrame(pd.DataFrame(rows, columns=["flight_id", "frame", "row_id", "x1", "y1", "x2", "y2", "confidence"])).repartition(3)
    for patience in (30, 4):
        out = motion.track_by_motion(boxes, patience=patience).collect()
        got = {(r.flight_id, r.row_id): r.track_id or 0 for r in out}
        for k, s in scenes.items():
            want = twin(s, patience)
            assert [got[k, i] for i in range(len(s))] == want and max(want) < 40 and want.count(0) > 0


def test_doubtful_boxes_hold_a_track_and_odd_rows_belong_to_none(spark):
    rows = [(1, f, f, 10.0 + f, 0.0, 20.0 + f, 8.0, 0.9 if f % 4 == 0 else 0.2) for f in range(12)]
    rows += [(1, 3, 50, None, 0.0, 1.0, 1.0, 0.9), (1, 4, 51, 5.0, 5.0, 5.0, 9.0, 0.9), (1, 5, 52, 300.0, 0.0, 310.0, 9.0, 0.05), (2, 0, 60, 0.0, 0.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(rows, "flight_id long, frame long, row_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {r.row_id: r.track_id for r in motion.track_by_motion(d).collect()}
    assert len(got) == len(rows) and all(got[f] == 1 for f in range(12)) and all(got[k] is None for k in (50, 51, 52, 60))
    assert motion.track_by_motion(d.where("false")).count() == 0


def test_a_box_by_itself_needs_no_matrix_and_frames_without_boxes_no_steps(monkeypatch):
    """Most frames hold one box; the frames between are added up at once, to the same numbers as one by one."""
    monkeypatch.setattr(motion, "optimal", lambda cost: (_ for _ in ()).throw(AssertionError("a matrix")))
    tracker = motion.TwoRounds()
    first, _ = tracker.frame(0, np.array([[0.0, 0, 10, 10], [40, 0, 50, 10], [80, 0, 90, 10]]), np.array([0.9, 0.9, 0.9]))
    assert first.tolist() == [1, 2, 3]
    assert [tracker.frame(f, np.array([[x, 0.0, x + 10, 10]]), np.array([0.9]))[0].tolist() for f, x in ((2, 41.0), (3, 1.0), (9, 82.0))] == [[2], [1], [3]]
    at_once, one_by_one = motion.Motion(), motion.Motion()
    for m in (at_once, one_by_one):
        m.begin([[0.0, 1.0, 3.0, 8.0], [5.0, 5.0, 7.5, 6.1]])
        m.step(1)
        m.see([1], np.array([[5.4, 5.0, 8.0, 6.3]]))
    at_once.step(37)
    for _ in range(37):
        one_by_one.step(1)
    assert np.array_equal(at_once.all, one_by_one.all)
