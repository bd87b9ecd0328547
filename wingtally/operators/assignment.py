"""Optimal and greedy one-to-one assignment, and the steps of a tracker that use them. Plain numpy: used inside grouped tasks."""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost, by shortest augmenting paths with potentials; the smaller side is matched whole."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in optimal(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            cur = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            free = ~used[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def optimal_edges(row: np.ndarray, column: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which edges make up the one-to-one assignment of most pairs and, among those, of least total cost (costs of 0 or more).

    Rows come in one after the other; each takes the cheapest alternating path, under potentials, to a free column or to a
    row that goes without. What is held follows the edges, not rows times columns. Edges that an earlier one repeats at its cost or less are not taken."""
    edges: dict[int, list[tuple[int, float, int]]] = {}
    seen: dict[tuple[int, int], float] = {}
    for k, (r, c, d) in enumerate(zip(row.tolist(), column.tolist(), cost.tolist(), strict=True)):
        if d < seen.get((r, c), np.inf):
            seen[r, c] = d
            edges.setdefault(r, []).append((c, d, k))
    # going without costs more than all that a further pair could add
    without = 1.0 + 2.0 * (len(edges) + 1) * float(cost.max()) if len(cost) else 1.0
    price: dict[int, float] = {}
    owner: dict[int, tuple[int, int]] = {}  # of a column: its row and edge
    taken: dict[int, float] = {}  # what a row's own edge costs
    for start in sorted(edges):
        best, via, done = {}, {}, {}
        heap, r, base = [], start, 0.0
        out, least_out = start, without  # the row that would go without, and the length of the path to it
        while True:
            own = taken[r] - price.get(via[r], 0.0) if r != start else 0.0
            if base - own + without < least_out:
                out, least_out = r, base - own + without
            for c, d, k in edges[r]:
                length = base - own + d - price.get(c, 0.0)
                if c not in done and length < best.get(c, (np.inf,))[0]:
                    best[c] = (length, r, k, d)
                    heapq.heappush(heap, (length, c))
            while heap and (heap[0][1] in done or heap[0][0] > best[heap[0][1]][0]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least_out:
                end, total = None, least_out
                break
            base, c = heapq.heappop(heap)
            done[c] = base
            if c not in owner:
                end, total = c, base
                break
            r = owner[c][0]
            via[r] = c
        for c, length in done.items():
            price[c] = price.get(c, 0.0) + length - total
        if end is None:  # that row gives its column up, if it is not the new one
            if out == start:
                continue
            end = via[out]
            taken.pop(out)
        while True:
            _, r, k, d = best[end]
            before = via.get(r)
            owner[end], taken[r] = (r, k), d
            if r == start:
                break
            end = before
    chosen = np.zeros(len(cost), bool)
    chosen[[k for _, k in owner.values()]] = True
    return chosen


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes, as float32."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    size = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = size(a)[:, None] + size(b)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0).astype(np.float32)


def overlap(a: list[float], b: list[float]) -> float:
    """Overlap of two boxes, as a float32."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if not (w > 0 and h > 0):
        return 0.0
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return float(np.float32(both / union)) if union > 0 else 0.0


def best_first(edges: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Edges (cost, row, column), the least first, each row and column once; ties by row, then column."""
    rows, columns, out = set(), set(), []
    for _, r, c in sorted(edges):
        if r not in rows and c not in columns:
            rows.add(r)
            columns.add(c)
            out.append((r, c))
    return out


class Places:
    """Boxes by number in cells of a grid, so that a box looks at those near it and not at all. Cells are as wide as a box's size, up to the next power of 2, or as `reach` for centres."""

    def __init__(self, reach: float | None = None):
        self.reach, self.cells, self.levels = reach, {}, {}

    def _cell(self, box: list[float]) -> tuple[int, int, int] | None:
        if self.reach is not None:
            x, y, level = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, 0
            size = self.reach or 1.0
        else:
            x, y, side = box[0], box[1], max(box[2] - box[0], box[3] - box[1])
            if not (box[2] > box[0] and box[3] > box[1] and math.isfinite(side)):
                return None  # overlaps nothing
            level = math.frexp(side)[1]
            size = 2.0**level
        return (level, math.floor(x / size), math.floor(y / size)) if math.isfinite(x) and math.isfinite(y) else None

    def put(self, number: int, box: list[float]) -> None:
        cell = self._cell(box)
        if cell is not None:
            if cell not in self.cells:
                self.levels[cell[0]] = self.levels.get(cell[0], 0) + 1
            self.cells.setdefault(cell, set()).add(number)

    def drop(self, number: int, box: list[float]) -> None:
        cell = self._cell(box)
        if cell is not None:
            self.cells[cell].discard(number)
            if not self.cells[cell]:
                del self.cells[cell]
                self.levels[cell[0]] -= 1
                if not self.levels[cell[0]]:
                    del self.levels[cell[0]]

    def near(self, box: list[float]) -> list[int]:
        """Numbers of all boxes that the box may overlap, or whose centre is within reach, and some others."""
        cell, out = self._cell(box), []
        if cell is None:
            return out
        for level in self.levels:
            if self.reach is not None:
                x0, x1, y0, y1 = cell[1] - 1, cell[1] + 1, cell[2] - 1, cell[2] + 1
            else:
                size = 2.0**level
                x0, x1, y0, y1 = math.floor(box[0] / size) - 1, math.floor(box[2] / size), math.floor(box[1] / size) - 1, math.floor(box[3] / size)
            if (x1 - x0 + 1) * (y1 - y0 + 1) > len(self.cells):
                return [n for held in self.cells.values() for n in held]
            for x in range(x0, x1 + 1):
                for y in range(y0, y1 + 1):
                    out += self.cells.get((level, x, y), ())
        return out


class Tracker:
    """Boxes of one flight, frame by frame, linked to tracks numbered from 1 as they open. Modes: greedy, hungarian, center, hungarian_center (overlap first, then nearness for the rest).

    A track that finds no box ages with each frame that has boxes, and closes when its age passes max_age (-1: never). It keeps its first class."""

    def __init__(self, mode: str = "hungarian", least: float = 0.3, class_aware: bool = True, max_age: int = -1, reach: float = 10.0):
        if least <= 0:
            raise ValueError("the least overlap must be above 0")
        self.mode, self.least, self.reach, self.class_aware, self.max_age = mode, float(np.float32(least)), reach, class_aware, max_age
        self.open: dict[int, tuple[list[float], int, int]] = {}  # box, class, frame of the last box, in counts of frames
        self.seen: dict[int, set[int]] = {}  # open tracks by that frame
        self.places = {how: Places(reach if how == "center" else None) for how in ("center", "overlap") if how in mode or (how == "overlap" and mode != "center")}
        self.next, self.clock = 1, 0

    def _edges(self, how: str, rows: list[int], found: list, classes: list[int], taken: set[int]) -> list[tuple[float, int, int]]:
        out = []
        for r in rows:
            for n in self.places[how].near(found[r]):
                box, kind, _ = self.open[n]
                if n in taken or (self.class_aware and kind != classes[r]):
                    continue
                if how == "overlap":
                    v = overlap(found[r], box)
                    if v >= self.least:
                        out.append((-v, r, n))
                else:
                    dx, dy = (found[r][0] + found[r][2]) / 2 - (box[0] + box[2]) / 2, (found[r][1] + found[r][3]) / 2 - (box[1] + box[3]) / 2
                    d = math.sqrt(dx * dx + dy * dy)
                    if d <= self.reach:
                        out.append((d, r, n))
        return out

    def _matched(self, found: list, classes: list[int]) -> list[tuple[int, int]]:
        """(box, track) pairs of one frame."""
        rows = list(range(len(found)))
        if not self.open:
            return []
        if self.mode in ("greedy", "center"):
            return best_first(self._edges("overlap" if self.mode == "greedy" else "center", rows, found, classes, set()))
        edges = self._edges("overlap", rows, found, classes, set())
        r, c = sorted({e[1] for e in edges}), sorted({e[2] for e in edges})
        if len(r) == len(edges) == len(c):  # nobody has a choice
            pairs = [(e[1], e[2]) for e in edges]
        else:
            cost = np.full((len(r), len(c)), 1e6, np.float32)
            for v, i, j in edges:
                cost[r.index(i), c.index(j)] = np.float32(1) + np.float32(v)
            pairs = [(r[i], c[j]) for i, j in optimal(cost) if cost[i, j] < 1e6]
        if self.mode == "hungarian_center":
            has = {p[0] for p in pairs}
            pairs += best_first(self._edges("center", [i for i in rows if i not in has], found, classes, {p[1] for p in pairs}))
        return pairs

    def _put(self, number: int, box: list[float], kind: int) -> None:
        if number in self.open:
            self._drop(number)
        self.open[number] = (box, kind, self.clock)
        self.seen.setdefault(self.clock, set()).add(number)
        for p in self.places.values():
            p.put(number, box)

    def _drop(self, number: int) -> None:
        box, _, seen = self.open.pop(number)
        self.seen[seen].discard(number)
        if not self.seen[seen]:
            del self.seen[seen]
        for p in self.places.values():
            p.drop(number, box)

    def frame(self, found: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Track ids of one frame's boxes."""
        found, classes = found.tolist(), classes.tolist()
        out = np.zeros(len(found), int)
        self.clock += 1
        for r, n in self._matched(found, classes):
            out[r] = n
            self._put(n, found[r], self.open[n][1])
        for r in np.flatnonzero(out == 0).tolist():
            out[r] = self.next
            self._put(self.next, found[r], classes[r])
            self.next += 1
        if self.max_age >= 0:
            for n in sorted(self.seen.get(self.clock - self.max_age - 1, ())):
                self._drop(n)
        return out


class Nearest:
    """Boxes of one flight, one after the other: each goes to the open track whose last box it overlaps most (`least` or more), or, by centres, is
    nearest to (under `reach`), or opens a track. A track is open for `offset` frames after its last box, and may take several boxes of a frame; among equal overlaps the first track wins, among equal distances the last."""

    def __init__(self, centres: bool = False, least: float = 0.6, reach: float = 5.0, offset: int = 5):
        self.centres, self.least32, self.reach, self.offset = centres, float(np.float32(least)), reach, offset
        self.frames = array("q")  # of each track's last box
        self.at: dict[int, dict[int, list[float]]] = {}  # frame, track: last box

    def take(self, frame: int, box: np.ndarray) -> int:
        box = box.tolist()
        near = sorted((t, b) for f in range(frame - self.offset, frame + self.offset + 1) for t, b in self.at.get(f, {}).items())
        best, value = None, None
        for t, last in near:
            if self.centres:
                v = float(np.hypot((last[0] + last[2]) / 2 - (box[0] + box[2]) / 2, (last[1] + last[3]) / 2 - (box[1] + box[3]) / 2))
                if v < self.reach and (best is None or v <= value):
                    best, value = t, v
            else:
                v = overlap(box, last)
                if v > 0 and v >= self.least32 and (best is None or v > value):
                    best, value = t, v
        if best is None:
            best = len(self.frames)
            self.frames.append(frame)
        elif frame >= self.frames[best]:
            del self.at[self.frames[best]][best]
            self.frames[best] = frame
        else:
            return best + 1
        self.at.setdefault(frame, {})[best] = box
        return best + 1

    def forget(self, frame: int) -> None:
        """Drops boxes that none of this frame or a later one can meet, where frames come in order; numbers of tracks stay taken."""
        for f in [f for f in self.at if f < frame - self.offset]:
            del self.at[f]
