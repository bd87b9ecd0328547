"""Tracking with a motion model and two rounds of matching: sure boxes first, then doubtful ones for the tracks that are left (after the published ByteTrack)."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .assignment import optimal, overlap
from .tracking import ordered, streamed

# The published noise of positions and speeds, as shares of a box's height, and of its aspect.
_PLACE, _SPEED, _ASPECT, _ASPECT_SPEED, _ASPECT_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1
_BOX = ["x1", "y1", "x2", "y2"]


def _noise(height: np.ndarray, share: float, aspect: float) -> np.ndarray:
    out = np.repeat((share * height)[..., None], 4, -1)
    out[..., 2] = aspect
    return out * out


class Motion:
    """Centres, aspects and heights of boxes at constant speed. The four do not disturb each other, so each is a filter of two numbers, all tracks and all four at once.

    `all` holds, by track: what they are, their speeds, the variances of these, what varies together, and the variances of the speeds."""

    def __init__(self):
        self.all = np.zeros((5, 0, 4))

    @staticmethod
    def measured(boxes: np.ndarray) -> np.ndarray:
        w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
        return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h], 1)

    def boxes(self) -> list[tuple[float, float, float, float]]:
        return [(x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2) for x, y, a, h in self.all[0].tolist()]

    def begin(self, boxes: list[list[float]]) -> None:
        new = []
        for x1, y1, x2, y2 in boxes:
            w, h = x2 - x1, y2 - y1
            place, speed = 2 * _PLACE * h, 10 * _SPEED * h
            place, speed = place * place, speed * speed
            new.append([[x1 + w / 2, y1 + h / 2, w / h, h], [0.0] * 4, [place, place, _ASPECT * _ASPECT, place], [0.0] * 4, [speed, speed, _ASPECT_SPEED * _ASPECT_SPEED, speed]])
        self.all = np.concatenate([self.all, np.array(new).transpose(1, 0, 2)], 1)

    def step(self, times: int) -> None:
        """So many frames further. Each number is a sum that grows from frame to frame, and all frames of it are added up at once, in order."""
        if times < 1 or not self.all.shape[1]:
            return
        at, speed, var, both, speed_var = self.all
        rows = lambda n: np.empty((n + 1, *at.shape))
        a, s, b, v = rows(times), rows(times), rows(times), rows(3 * times)
        a[0], a[1:] = at, speed
        a = np.add.accumulate(a, 0)
        h = a[:-1, :, 3:]
        s[0], s[1:] = speed_var, np.square(_SPEED * h)
        s[1:, :, 2] = _ASPECT_SPEED**2
        s = np.add.accumulate(s, 0)
        b[0], b[1:] = both, s[:-1]
        b = np.add.accumulate(b, 0)
        v[0], v[1::3], v[2::3], v[3::3] = var, 2 * b[:-1], s[:-1], np.square(_PLACE * h)
        v[3::3, :, 2] = _ASPECT**2
        v = np.add.accumulate(v, 0)
        self.all = np.array([a[-1], speed, v[-1], b[-1], s[-1]])

    def see(self, which: list[int], boxes: np.ndarray) -> None:
        at, speed, var, both, speed_var = self.all[:, which]
        gone = self.measured(boxes) - at
        total = var + _noise(at[:, 3], _PLACE, _ASPECT_SEEN)
        gain, speed_gain = var / total, both / total
        self.all[:, which] = np.stack([at + gain * gone, speed + speed_gain * gone, var * (1 - gain), both * (1 - gain), speed_var - speed_gain * both])

    def keep(self, which: list[int]) -> None:
        self.all = self.all[:, which]


_NEW, _SEEN, _LOST = range(3)


class TwoRounds:
    """Boxes of one flight, frame by frame. Per frame: sure boxes (confidence of `sure` or more) go to seen and lost tracks, most pairs and then least
    1 - overlap, up to `first`; doubtful ones (`doubtful` or more) to seen tracks that are left, up to `second`; sure ones that are left to new tracks, up to `again`.

    A sure box that is left and has a confidence of `new` begins a track, which counts when the next frame that has boxes confirms it (in a
    flight's first frame at once). A track without a box is lost, and gone after `patience` frames. Numbers are given as tracks come to count.
    Frames of few boxes are the many, so what is decided box by box is in plain numbers."""

    def __init__(self, sure: float = 0.5, doubtful: float = 0.1, new: float = 0.6, first: float = 0.8, second: float = 0.5, again: float = 0.7, patience: int = 30):
        self.sure, self.doubtful, self.new, self.limits, self.patience = sure, doubtful, new, (first, second, again), patience
        self.motion = Motion()
        self.state: list[int] = []
        self.seen: list[int] = []
        self.ids: list[int] = []
        self.opened: list[int] = []
        self.count, self.last = 0, None

    @staticmethod
    def _matched(boxes: list, found: list[int], of_tracks: list, tracks: list[int], limit: float) -> list[tuple[int, int]]:
        cost = [[1.0 - overlap(boxes[d], of_tracks[t]) for t in tracks] for d in found]
        if not any(c <= limit for row in cost for c in row):
            return []
        if len(found) == 1:
            return [(found[0], tracks[cost[0].index(min(cost[0]))])]
        if len(tracks) == 1:
            column = [row[0] for row in cost]
            return [(found[column.index(min(column))], tracks[0])]
        return [(found[r], tracks[c]) for r, c in optimal(np.array([[c if c <= limit else 1e6 for c in row] for row in cost])) if cost[r][c] <= limit]

    def frame(self, frame: int, boxes: np.ndarray, confidence: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Track numbers of one frame's boxes (0: none), and (place of the box that opened it, number) of tracks that came to count; places are `opened`'s."""
        begin = self.last is None
        self._keep([frame - seen <= self.patience for seen in self.seen])
        lost = [t for t, state in enumerate(self.state) if state == _LOST]
        if lost:
            self.motion.all[1, lost, 3] = 0.0
        if not begin:
            self.motion.step(min(frame - self.last, self.patience + 1))
        self.last = frame
        out, came = np.zeros(len(boxes), int), []
        sizes = confidence.tolist()
        sure = [d for d, c in enumerate(sizes) if c >= self.sure]
        doubtful = [d for d, c in enumerate(sizes) if self.doubtful <= c < self.sure]
        rounds = ((sure, (_SEEN, _LOST), self.limits[0]), (doubtful, (_SEEN,), self.limits[1]), (sure, (_NEW,), self.limits[2]))
        places, of_tracks = boxes.tolist(), self.motion.boxes()
        taken_box: set[int] = set()
        taken: set[int] = set()
        pairs: list[tuple[int, int]] = []
        for found, states, limit in rounds:
            left = [d for d in found if d not in taken_box]
            tracks = [t for t, state in enumerate(self.state) if state in states and t not in taken] if left else []
            if tracks:
                now = self._matched(places, left, of_tracks, tracks, limit)
                taken_box.update(d for d, _ in now)
                taken.update(t for _, t in now)
                pairs += now
        for d, t in sorted(pairs):
            if self.state[t] == _NEW:
                self.count += 1
                self.ids[t] = self.count
                came.append((self.opened[t], self.count))
            out[d] = self.ids[t]
        if pairs:
            self.motion.see([t for _, t in pairs], boxes[[d for d, _ in pairs]])
            for _, t in pairs:
                self.state[t], self.seen[t] = _SEEN, frame
        for t, state in enumerate(self.state):
            if state == _SEEN and t not in taken:
                self.state[t] = _LOST
        self._keep([t in taken or state == _LOST for t, state in enumerate(self.state)])
        fresh = [d for d in sure if d not in taken_box and sizes[d] >= self.new]
        if fresh:
            self.motion.begin([places[d] for d in fresh])
            if begin:
                out[fresh] = np.arange(self.count + 1, self.count + 1 + len(fresh))
                self.count += len(fresh)
            self.state += [_SEEN if begin else _NEW] * len(fresh)
            self.seen += [frame] * len(fresh)
            self.ids += out[fresh].tolist()
            self.opened += fresh
        return out, came

    def _keep(self, which: list[bool]) -> None:
        if all(which):
            return
        left = [t for t, stays in enumerate(which) if stays]
        self.motion.keep(left)
        self.state, self.seen, self.ids, self.opened = ([held[t] for t in left] for held in (self.state, self.seen, self.ids, self.opened))


def track_by_motion(detections: DataFrame, key: str = "flight_id", **how) -> DataFrame:
    """detections (key, frame, row_id, box, confidence) with the track_id that TwoRounds gives each, null for boxes that belong to no track; a flight is read in order of frames in one task.

    The box that opens a track gets its number too, so a frame waits for the next one that has boxes; a task holds a batch of a flight and what waits, and no flight whole.
    Boxes without height or width, or with missing values, belong to none."""
    kind = dict(detections.dtypes)
    columns = [key, "frame", "row_id"]

    def flight():
        tracker, before = TwoRounds(**how), None
        open_ids: np.ndarray = np.zeros(0, int)

        def run(pdf: pd.DataFrame, starts: np.ndarray) -> list[tuple[pd.DataFrame, np.ndarray]]:
            """Rows whose numbers are settled by these whole frames, and their numbers; the last frame that has boxes waits, with what follows it."""
            nonlocal before, open_ids
            boxes, confidence, frames = pdf[_BOX].to_numpy(float), pdf["confidence"].to_numpy(float), pdf["frame"].to_numpy()
            good = np.isfinite(boxes).all(1) & np.isfinite(confidence) & (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
            ids, done, held = np.zeros(len(pdf), int), [], 0
            last: np.ndarray | None = None
            for a, b in itertools.pairwise([*starts.tolist(), len(pdf)]):
                here = a + np.flatnonzero(good[a:b])
                if not len(here):
                    continue
                ids[here], came = tracker.frame(int(frames[a]), boxes[here], confidence[here])
                for place, number in came:  # opened in the frame before
                    if last is not None:
                        ids[last[place]] = number
                    else:
                        open_ids[before[1][place]] = number
                last, held = here, a
            if last is None:  # no boxes: what waits goes on waiting
                return [(pdf[columns], ids)]
            if before is not None:
                done.append((before[0], open_ids))
            done.append((pdf[columns].iloc[:held], ids[:held]))
            before, open_ids = (pdf[columns].iloc[held:], last - held), ids[held:].copy()
            return done

        return run, lambda: [(before[0], open_ids)] if before is not None else []

    def run(batches):
        for rows, ids in streamed(batches, key, flight):
            if len(rows):
                yield rows.assign(track_id=pd.array(ids, "Int64")).replace({"track_id": {0: pd.NA}})

    return ordered(detections.select(*columns, *_BOX, "confidence"), key).mapInPandas(run, f"{key} {kind[key]}, frame {kind['frame']}, row_id {kind['row_id']}, track_id long")
