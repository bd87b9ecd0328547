"""N-gram Jaccard join by prefix trees, whole and exact, with connected components.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of 0.75 or more. Equal sets are one class from the start; what follows works on
distinct sets, known by a 64-bit key, and never on pairs of copies.

1. One pass makes each document's set, its key and its size. The same pass
   counts shingles in each task and reports those that are frequent there; the
   most frequent of all (a bounded list) go to every task. Shingles are ordered
   from rare to frequent by that list and then by hash: an order that any task
   can make for itself. Any order gives right results; this one keeps passages
   that many documents share out of the prefixes.
2. Linked sets share a shingle within their prefixes of n - ceil(0.75 n) + 1.
   Each prefix shingle gets a label, the least key among the sets that have it,
   and a set is routed to the labels of its shingles. Linked sets meet in at
   least one label's group; near copies mostly have one label, so a set goes to
   few groups. Postings are shuffled packed, a binary a bucket. Labels of the
   frequent shingles come with the list, so no bucket fills up with one of them.
   Sets of a shingle that is not frequent get a label for each run of sizes
   without a gap of a third, as sets of other sizes never link.
   Sketches of the sets (a count for each of n / 2 cells) bound the overlaps in
   a group, of pairs whose sizes agree and that came by one shingle (64 bits tell
   by which ones a set came). What may link so falls into clusters, of which the
   least set is the new label; a set alone goes no further. So whole sets travel
   for likely links alone, and sets that merely share shingles with one large
   set are not met with each other.
3. A group's sets are stored in a trie, each in the global order read from its
   end, frequent shingles first, so that sets share beginnings. Each set walks it
   with the overlap so far; a branch ends where the rest of either set cannot
   bring the overlap that any size below it needs, or where all below is already
   connected to it. Only links that join two components are reported.
4. Clusters over CHUNK sets are split by hash into chunks; the cluster's least
   set is in each, so that a big one of near copies falls into one component at
   once. Sets outside the cluster's largest component then meet every chunk, in
   blocks. Labels of over SKETCHED sets go to chunks without sketches.
5. Links become components (see components.py).

Shingles and keys are 64-bit hashes, taken as the shingles themselves: over
10 billion distinct sets, some three pairs of keys may be expected to clash.

Defined cases: ties, and columns of any other name in the input, have no say. A text without words, or null, has the empty set, links with
nothing and is its own component. Rows of one doc_id are one vertex only if
their sets are equal; otherwise each has its component. A null doc_id takes part
and never names a component (unless all of its component are null). An empty
table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

SIZE, CHUNK = 5, 1024
#: Sets of one label that one task sketches together.
SKETCHED = 1 << 15
#: Frequent shingles sent to every task, and how often one must occur in a task and in all to be on the list.
FREQUENT, IN_TASK, IN_ALL = 200_000, 4, 32
_HELD = 4_000_000


def shingles(text: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each row, and the rows' offsets. A text of fewer words is one shingle."""
    w = shared.Words(text)
    h = w.hashes()
    n = np.diff(w.off_w)
    x, doc = shared.windows(h, size), w.doc[: max(0, len(h) - size + 1)]
    ok = doc == w.doc[size - 1 :] if len(x) else np.zeros(0, bool)
    x, doc = x[ok], doc[ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([_whole(h[w.off_w[i] : w.off_w[i + 1]]) for i in short], np.uint64)
        x, doc = np.concatenate([x, whole]), np.concatenate([doc, short])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(w.n + 1))


def _whole(h: np.ndarray) -> np.uint64:
    """Hash of a short row of words, of which each counts by its place."""
    place = shared.mixed(np.arange(1, len(h) + 1, dtype=np.uint64))
    return shared.mixed(shared.mixed(h ^ place).sum(keepdims=True) + place[-1:])[0]


def keys(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A key of each set: equal for equal sets."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(shared.mixed(x ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return shared.mixed(total[off[1:]] - total[off[:-1]] + shared.mixed(np.diff(off).astype(np.uint64))).view(np.int64)


def _counted(tok: list, key: list, cnt: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, k, c = np.concatenate(tok), np.concatenate(key), np.concatenate(cnt)
    order = np.argsort(t)
    t, k, c = t[order], k[order], c[order]
    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    if not len(at):
        return t, k, c
    c, k, t = np.add.reduceat(c, at), np.minimum.reduceat(k, at), t[at]
    use = c >= least
    return t[use], k[use], c[use]


_SET = ["doc_id", "text_hash", "n", "k", "sketch", "token", "low", "cnt"]


def _sketch(x: np.ndarray) -> bytes | None:
    """How many of the set's hashes fall into each of a power of two of cells, about two a cell; None if a byte can't hold it."""
    if not len(x):
        return None
    cells = 1 << max(4, (len(x) // 2).bit_length())
    count = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


class _Sketches:
    """Sketches of sets in order of size; wider ones are folded to the width of the one that they are held against."""

    def __init__(self, sketches: list[bytes]):
        self.raw = [np.frombuffer(x, np.uint8) for x in sketches]
        self.cells = np.array([len(x) for x in self.raw])
        self.width = self.low = self.high = 0

    def overlaps(self, i: int, near: np.ndarray) -> np.ndarray:
        """The most that set i can share with each of near, which come after it and so have as many cells or more."""
        width, last = int(self.cells[i]), int(near[-1]) + 1
        most = max(1, _HELD // width)
        if last - i - 1 <= most and (width != self.width or last > self.high):
            self.width, self.low = width, i + 1
            self.high = max(last, min(i + 1 + most, int(np.searchsorted(self.cells, 2 * width, "right"))))
            self.rows = np.stack([self._folded(j, width) for j in range(self.low, self.high)])
        own, out = self._folded(i, width), []
        for a in range(0, len(near), step := max(1, (1 << 20) // width)):
            part = near[a : a + step]
            held = width == self.width and last <= self.high
            table = self.rows[part - self.low] if held else np.stack([self._folded(j, width) for j in part.tolist()])
            out.append(np.minimum(own, table).sum(1, dtype=np.int64))
        return np.concatenate(out)

    def _folded(self, j: int, width: int) -> np.ndarray:
        return self.raw[j].reshape(-1, width).sum(0, dtype=np.uint16)


def _possible(similar: int):
    """(k, label) of the sets that may link to another of their label, the label now the least set that they may reach
    by such links.

    Sets share at most the sum over cells of the smaller count, and linked sets of one label came by one shingle at
    least, so no linked pair is parted."""

    def kept(rows: list) -> list:
        if len(rows) < 2:
            return []
        if any(r[4] is None for r in rows):
            lead = min(r[0] for r in rows)
            return [(r[0], lead) for r in rows]
        rows = sorted(rows, key=lambda r: (r[3], r[0]))
        n, by = np.array([r[3] for r in rows]), np.array([r[2] for r in rows], np.int64)
        ends = np.searchsorted(n, n * 100 // similar, "right")
        group, sketches = np.arange(len(rows)), _Sketches([r[4] for r in rows])
        for i, end in enumerate(ends.tolist()):
            near = i + 1 + np.flatnonzero((by[i + 1 : end] & by[i] != 0) & (group[i + 1 : end] != group[i]))
            if len(near):
                near = near[(100 + similar) * sketches.overlaps(i, near) >= similar * (n[i] + n[near])]
            if len(near) > 1:
                group[np.isin(group, group[near])] = group[i]
            elif len(near):
                group[group == group[near[0]]] = group[i]
        k = np.array([r[0] for r in rows], np.int64)
        _, at, m = np.unique(group, return_inverse=True, return_counts=True)
        lead = np.full(len(m), np.iinfo(np.int64).max)
        np.minimum.at(lead, at, k)
        return list(zip(k[m[at] > 1].tolist(), lead[at][m[at] > 1].tolist(), strict=True))

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 2], names=["k", "label"])

    def run(batches):
        at, rows = None, []
        for b in batches:
            out = []
            for label, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if label != at:
                    out += kept(rows)
                    at, rows = label, []
                rows.append((row[0], label, *row[1:]))
            yield batch(out)
        yield batch(kept(rows))

    return run


def _sets(size: int):
    """Rows (doc_id, text_hash, n, k, sketch) of documents, then rows (token, low, count) of the task's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        tok, key, cnt, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part in shared.pieces(batch):
                x, off = shingles(part.column(1), size)
                k, n = keys(x, off), np.diff(off)
                none = pa.nulls(len(n), pa.int64())
                sketch = pa.array([_sketch(x[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(k, pa.int64(), mask=n == 0), sketch, none, none, none], names=_SET)
                new = np.array([i for i, a in enumerate(k.tolist()) if n[i] and not (a in seen or seen.add(a))], np.int64)
                if len(new):
                    at = np.concatenate([np.arange(off[i], off[i + 1]) for i in new])
                    tok.append(x[at])
                    key.append(np.repeat(k[new], n[new]))
                    cnt.append(np.ones(len(at), np.int64))
                    held += len(at)
                if held > _HELD:
                    tok, key, cnt = ([v] for v in _counted(tok, key, cnt, 2))
                    held = len(tok[0])
                    if held > _HELD // 2:
                        tok, key, cnt = ([v] for v in _counted(tok, key, cnt, int(np.median(cnt[0])) + 1))
                        held = len(tok[0])
                    seen.clear()
        t, k, c = _counted(tok, key, cnt, IN_TASK)
        if len(t):
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(t), kind), none, none, none, pa.nulls(len(t), pa.binary()), pa.array(t.view(np.int64)), pa.array(k), pa.array(c)], names=_SET)

    return run


class Order:
    """The order of shingles: rank 0 for all that are not on the list of frequent ones, then by count."""

    def __init__(self, token: np.ndarray, count: np.ndarray, label: np.ndarray):
        order = np.argsort(token)
        self.token, self.count, self.label = token[order], count[order], label[order]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not on the list) and place on the list."""
        if not len(self.token):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.token, x), len(self.token) - 1)
        return np.where(self.token[at] == x, self.count[at], 0), at


_POSTING = ["tokens", "keys", "sizes", "labels", "owners", "bits"]
#: Steps of size between two sets that just link.
_STEPS = 8


def _step(n: np.ndarray, similar: int) -> np.ndarray:
    """The size of a set in steps, _STEPS of them to the ratio of sizes that may link; of sets that link they differ by _STEPS + 1 at most."""
    return (np.log(n) * (_STEPS / -np.log(min(similar, 99) / 100))).astype(np.uint16)


def _bit(token: np.ndarray) -> np.ndarray:
    """One of 64 bits for each shingle."""
    return (np.uint64(1) << (token >> np.uint64(58))).view(np.int64)


def _united(k: np.ndarray, label: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (k, label) once, with the bits of all its rows."""
    if not len(k):
        return k, label, bits
    order = np.lexsort((label, k))
    k, label, bits = k[order], label[order], bits[order]
    at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (label[1:] != label[:-1])])
    return k[at], label[at], np.bitwise_or.reduceat(bits, at)


def _postings(order, size: int, similar: int, buckets: int):
    """Rows (bucket, tokens, keys, sizes, labels, owners, bits): the prefixes' shingles, packed."""

    def run(batches):
        o = order.value
        for batch in batches:
            rows: dict[int, list] = {}
            seen: set[int] = set()
            for part in shared.pieces(batch):
                x, off = shingles(part.column(0), size)
                k, n = keys(x, off), np.diff(off)
                new = np.array([not (a in seen or seen.add(a)) for a in k.tolist()], bool) & (n > 0)
                doc = np.repeat(np.arange(len(n)), n)
                count, place = o.find(x)
                by = np.lexsort((x, count, doc))
                in_doc = np.arange(len(x)) - off[doc]
                prefix = n - -(-similar * n // 100) + 1
                by = by[(in_doc < prefix[doc]) & new[doc]]
                tok, key, rare, step = x[by], k[doc[by]], count[by] == 0, _step(n[doc[by]], similar)
                label = o.label[place[by][~rare]] if len(o.token) else np.zeros(0, np.int64)
                owner, label, bits = _united(key[~rare], label, _bit(tok[~rare]))
                tok, key, step = tok[rare], key[rare], step[rare]
                for b, i in _dealt((tok % np.uint64(buckets)).astype(np.int64)):
                    for held, c in zip(rows.setdefault(b, [[] for _ in _POSTING]), (tok, key, step), strict=False):
                        held.append(c[i])
                for b, i in _dealt(label % buckets):
                    for held, c in zip(rows.setdefault(b, [[] for _ in _POSTING])[3:], (label, owner, bits), strict=True):
                        held.append(c[i])
            packed = [[b"".join(a.tobytes() for a in rows[b][j]) for b in rows] for j in range(len(_POSTING))]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], names=["bucket", *_POSTING])

    return run


def _dealt(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if not len(b):
        return
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for a, z in zip(cut, [*cut[1:], len(b)], strict=True):
        yield int(b[a]), order[a:z]


def _routes(batches):
    """(k, label, bits) once for each set and label in a bucket; the rows of a bucket come together."""

    def pairs(*held):
        kinds = [np.uint64, np.int64, np.uint16, np.int64, np.int64, np.int64]
        t, k, step, label, owner, bits = (np.frombuffer(b"".join(h), kind) for h, kind in zip(held, kinds, strict=True))
        if len(t):
            order = np.lexsort((step, t))
            t, k, step = t[order], k[order], step[order].astype(np.int64)
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (step[1:] - step[:-1] > _STEPS + 1)])
            low, high, n = np.minimum.reduceat(k, at), np.maximum.reduceat(k, at), np.diff(np.r_[at, len(t)])
            low, ok = np.repeat(low, n), np.repeat(low != high, n)
            owner, label, bits = np.r_[owner, k[ok]], np.r_[label, low[ok]], np.r_[bits, _bit(t[ok])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _united(owner, label, bits)], names=["k", "label", "bits"])

    bucket, held = None, [[] for _ in _POSTING]
    for batch in batches:
        for b, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and bucket is not None:
                yield pairs(*held)
                held = [[] for _ in _POSTING]
            bucket = b
            for h, x in zip(held, blobs, strict=True):
                h.append(x)
    if bucket is not None:
        yield pairs(*held)


class Trie:
    """Sets of ordered numbers with shared beginnings stored once.

    rows are in lexicographic order, so the sets below a node are rows[low:high].
    """

    def __init__(self, sets: list[np.ndarray]):
        self.rows = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.rows]
        self.size = np.array([len(s) for s in self.sets])
        m = len(self.sets)
        shared_len = [0] * (m + 1)
        for i in range(1, m):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared_len[i] = int(differ[0]) if len(differ) else n
        #: (depth from, depth to, low, high, children)
        nodes = [self._node(0, m, 0, shared_len)]
        for node in nodes:  # level by level, so that a node's children follow each other
            nodes += node[4]
        self.start, self.end, self.low, self.high = (np.array([n[i] for n in nodes]) for i in range(4))
        self.children = np.array([len(n[4]) for n in nodes])
        self.first = 1 + np.cumsum(self.children) - self.children
        self.least, self.most = (np.array([f(self.size[n[2] : n[3]]) for n in nodes]) for f in (np.min, np.max))
        self.numbers = np.concatenate([self.sets[n[2]][n[0] : n[1]] for n in nodes]).astype(np.int32)
        self.to = np.cumsum(self.end - self.start)

    def _node(self, low: int, high: int, depth: int, common: list[int]):
        root = [depth, depth, low, high, []]
        work = [(root, low, high, depth)]
        while work:
            node, low, high, depth = work.pop()
            to = min(common[low + 1 : high], default=len(self.sets[low])) if high - low > 1 else len(self.sets[low])
            node[1] = max(to, depth)
            if high - low == 1:
                continue
            start = low
            for i in [*(j for j in range(low + 1, high) if common[j] == to), high]:
                child = [to, to, start, i, []]
                node[4].append(child)
                work.append((child, start, i, to))
                start = i
        return root

    def near(self, q: np.ndarray, mask: np.ndarray, similar: int, known: np.ndarray) -> np.ndarray:
        """Rows whose set is similar to q, a level of branches at a time; mask marks q's numbers, known the rows whose branches are left out."""
        nq, rows, hits = len(q), np.r_[0, np.cumsum(known)], np.r_[0, np.cumsum(mask[self.numbers], dtype=np.int32)]
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            need = -(-similar * (nq + self.least[node]) // (100 + similar))
            ok = (rows[self.high[node]] - rows[self.low[node]] < self.high[node] - self.low[node]) & (np.minimum(nq, self.most[node]) >= need)
            node, overlap, need = node[ok], overlap[ok], need[ok]
            to, size = self.to[node], self.end[node] - self.start[node]
            overlap = overlap + hits[to] - hits[to - size]
            rest = np.where(size > 0, nq - np.searchsorted(q, self.numbers[to - 1], "right"), nq - overlap)
            ok = overlap + np.minimum(rest, self.most[node] - self.end[node]) >= need
            node, overlap = node[ok], overlap[ok]
            children = self.children[node]
            ends = (children == 0) & (100 * overlap >= similar * (nq + self.least[node] - overlap))
            found.append(self.low[node[ends]])
            node, overlap = _ranges(self.first[node], children), np.repeat(overlap, children)
        return np.concatenate(found)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, size of them, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def joined(sets: list[np.ndarray], asks: list[int] | None, similar: int, order: Order) -> list[tuple[int, int]]:
    """Links among the sets, enough of them for their components; asks: the rows that look for links (all if None)."""
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, order.find(ids)[0]))[::-1]] = np.arange(len(ids))
    cut = np.cumsum([len(s) for s in sets])[:-1]
    sets = [np.sort(x) for x in np.split(rank[inverse], cut)]
    trie, mask = Trie(sets), np.zeros(len(ids), bool)
    place = np.empty(len(sets), np.int64)
    place[trie.rows] = np.arange(len(sets))
    group = np.arange(len(sets))  # component of each row of the trie
    links, asked = [], np.zeros(len(sets), bool)
    left = list(reversed(trie.rows if asks is None else asks))
    later, largest = [], 0
    while left:
        i = left.pop()
        q, own = sets[i], int(place[i])
        if asks is None and group[own] == group[largest] and own != largest:
            later.append(i)  # rows of the largest component need not ask if all others do
            continue
        mask[q] = True
        for j in trie.near(q, mask, similar, asked | (group == group[own])).tolist():
            if group[j] != group[own]:
                links.append((i, trie.rows[j]))
                group[group == group[j]] = group[own]
        mask[q] = False
        asked[own] = True
        if np.count_nonzero(group == group[own]) > np.count_nonzero(group == group[largest]):
            left, later, largest = later[::-1] + left, [], own
    return links


def _sent(size: int):
    """(label, chunk, block, asks, k, tokens) for each set's targets, once a task for repeated rows; only a text whose set has the wanted key counts."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for part in shared.pieces(batch):
                x, off = shingles(part.column(1), size)
                k = keys(x, off)
                want, targets = part.column(0).to_pylist(), part.column(2).to_pylist()
                rows = [(t["label"], t["chunk"], t["block"], t["asks"], want[i], x[off[i] : off[i + 1]].tobytes()) for i in range(len(want)) if want[i] == k[i] and not (want[i] in done or done.add(want[i])) for t in targets[i]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["label", "chunk", "block", "asks", "k", "tokens"])

    return run


def _linked(similar: int, order):
    """Links (a, b) of each group; the rows of a group come together."""

    def links(rows: dict):
        ks = list(rows)
        if len(ks) < 2:
            return [], []
        asks = [i for i, k in enumerate(ks) if rows[k][0]]
        found = joined([np.frombuffer(rows[k][1], np.uint64) for k in ks], None if len(asks) == len(ks) else asks, similar, order.value)
        return [ks[i] for i, _ in found], [ks[j] for _, j in found]

    def run(batches):
        at, rows = None, {}
        for batch in batches:
            a, b = [], []
            for label, chunk, block, asks, k, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, chunk, block) != at:
                    x, y = links(rows)
                    a, b, at, rows = a + x, b + y, (label, chunk, block), {}
                rows[k] = (asks or (k in rows and rows[k][0]), tokens)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        x, y = links(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similar: int = 75, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, text_hash (xxhash64 of the text), n_shingles, k (the set's key) and component_id."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    n_tasks = shared.tasks(spark)
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    both = shared.written(d.mapInArrow(_sets(size), f"doc_id {kind}, text_hash long, n long, k long, sketch binary, token long, low long, cnt long"), "sets")
    sets = both.where("n is not null").select("doc_id", "text_hash", "n", "k", "sketch")
    often = both.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("c"), F.min("low").alias("low")).where(F.col("c") >= IN_ALL).orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    order = spark.sparkContext.broadcast(Order(often["token"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64), often["low"].to_numpy(np.int64)))
    packed = d.select("text").mapInArrow(_postings(order, size, similar, 4 * n_tasks), f"bucket long, {', '.join(f'{c} binary' for c in _POSTING)}")
    routes = packed.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_routes, "k long, label long, bits long").groupBy("k", "label").agg(F.bit_or("bits").alias("bits"))
    routes = shared.written(routes, "routes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc"), F.col("text_hash").alias("doc_text")))
    first = sets.where("k is not null").groupBy("k").agg(least.alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    first = shared.written(first.select("k", "least.doc", "least.doc_text", "n", "sketch"), "first")

    m = routes.groupBy("label").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("label", "g")
    grouped = routes.join(m, routes["label"] == m["g"]).select("k", "label", "bits", "m")
    small = grouped.where(F.col("m") <= SKETCHED).join(first, "k").select("label", "k", "bits", "n", "sketch")
    small = small.repartition(n_tasks, "label").sortWithinPartitions("label").mapInArrow(_possible(similar), "k long, label long")
    members = small.unionByName(grouped.where(F.col("m") > SKETCHED).select("k", "label")).distinct()
    members = shared.written(members, "near")
    groups = members.groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("chunks")).withColumnRenamed("label", "g")
    members = members.join(groups, members["label"] == groups["g"]).withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")))
    members = shared.written(members.select("k", "label", "chunk", "chunks"), "members")
    pivots = members.where((F.col("chunks") > 1) & (F.col("k") == F.col("label"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def meet(targets: DataFrame) -> DataFrame:
        """Links found when each set goes to its targets (k, label, chunk, block, asks)."""
        to = targets.groupBy("k").agg(F.collect_set(F.struct("label", "chunk", "block", "asks")).alias("targets"))
        to = to.join(first, "k").select("k", "doc", "doc_text", "targets")
        sent = d.join(to, d["doc_id"].eqNullSafe(to["doc"]) & (d["text_hash"] == to["doc_text"])).select("k", "text", "targets")
        sent = sent.mapInArrow(_sent(size), "label long, chunk long, block long, asks boolean, k long, tokens binary")
        sent = sent.repartition(n_tasks, "label", "chunk", "block").sortWithinPartitions("label", "chunk", "block", "k")
        return shared.written(sent.mapInArrow(_linked(similar, order), "a long, b long"), "links")

    links = meet(members.unionByName(pivots).select("k", "label", "chunk", F.lit(0).cast("long").alias("block"), F.lit(True).alias("asks")))
    roots = components(links, "classes")
    big = members.where("chunks > 1")
    if not big.isEmpty():
        own = roots.select(F.col("node").alias("k"), F.col("root").alias("r"))
        big = big.join(own, "k", "left").withColumn("r", F.coalesce("r", "k"))
        main = big.groupBy("label", "r").agg(F.count("*").alias("c")).groupBy("label").agg(F.max(F.struct("c", "r")).getField("r").alias("main"))
        big = shared.written(big.join(main, "label"), "big")
        out = big.where(F.col("r") != F.col("main"))
        blocks = out.groupBy("label").agg(F.ceil(F.count("*") / chunk).alias("blocks"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asking = out.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64(F.col("k"), F.lit(1)), "blocks")).withColumn("chunk", upto("chunks")).withColumn("asks", F.lit(True))
        asked = big.join(blocks, "label").withColumn("block", upto("blocks")).withColumn("asks", F.lit(False))
        names = ["k", "label", "chunk", "block", "asks"]
        more = meet(asking.select(names).unionByName(asked.select(names)))
        if not more.isEmpty():
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "classes")
    own = first.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = own.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = own.join(least, "root").select(F.col("k").alias("key"), "component_id")
    out = sets.join(named, sets["k"] == named["key"], "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
