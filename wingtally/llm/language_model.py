"""Scoring with a gated recurrent language model, and with counts of single words.

Counts. Each task sums its words (64-bit hashes) and sends packed sums by hash
bucket; a bucket's counts are whole after one shuffle. The most frequent words
go to every task (HEAD of them: a fixed bound); what a text holds of all other
words is shuffled to the buckets and its sums come back. Those words are rare by
choice, so no bucket is hot, and copies of a text count once on the way.

Model. A recurrent network with gates reads one word after the other; its output
softmax is factored into classes of words of like frequency, and the words of a
class. Words beyond the vocabulary are one word for the network and are told
apart by their counts, so every text has a probability. Training is truncated
backpropagation in numpy: in each round every task starts from the same weights,
runs through its own training texts, and the weights are averaged by words read.
Scoring carries the state from window to window until a text ends.

Mixture. The network's probability of each word is mixed with that of the counts,
which counts more where little was learned. The network does not learn from every
ASIDE-th training text (by a hash of its key and words); the weight is the one of
WEIGHTS under which these texts are most probable. Their sums grow with the
corpus, one row a task comes back.

Defined cases: a null text is empty, that is, one end token. Repeated rows get
the same answer each. Rows without a doc_id are held out of training. With no
training texts, all words are unknown and the network has its first weights; with
none set aside, the network and the counts weigh the same. An
empty table gives an empty result. Whole texts are read, however long; other
columns are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words in every task's table, words of the network, classes of its output, numbers of its state.
HEAD, VOCABULARY, CLASSES, STATE = 200_000, 6_000, 80, 16
#: Rounds of training, each over its own part of the training texts.
ROUNDS = 2
LANES, WINDOW = 128, 32
#: Words that are dealt to the lanes at once in training.
AT_ONCE = 4_000_000
END = np.uint64(0xE17D_0000_0000_0001)
#: Of so many training texts one is set aside, for the choice among these weights of the network beside the counts.
ASIDE, WEIGHTS = 20, np.r_[0.02, 0.05, np.arange(0.1, 1, 0.1), 0.95, 0.98]
_HELD = 4_000_000


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row's 'text', an end after each row, and the rows' offsets; hashed a block at a time, as a block needs many times its bytes."""
    parts = [_tokens(p.column(p.schema.get_field_index("text"))) for p in shared.pieces(batch)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    h, off = zip(*parts, strict=True)
    return np.concatenate(h), np.r_[0, np.cumsum(np.concatenate([np.diff(o) for o in off]))]


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = shared.Words(text)
    n = np.diff(w.off_w) + 1
    off = np.r_[0, np.cumsum(n)]
    out = np.full(off[-1], END, np.uint64)
    out[np.arange(len(w.start)) + w.doc] = w.hashes()
    return out, off


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _packed(h: np.ndarray, c: np.ndarray, buckets: int) -> pa.RecordBatch:
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    h, c, b = h[order], c[order], b[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    end = np.r_[at[1:], len(b)][: len(at)]
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(b[at], pa.int64()), cut(h), cut(c)], names=["bucket", "tokens", "counts"])


def _count(buckets: int):
    def run(batches):
        h, c, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for part in shared.pieces(batch):
                x, n = np.unique(tokens(part)[0], return_counts=True)
                h.append(x)
                c.append(n.astype(np.int64))
                held += len(x)
                if held > _HELD:
                    x, n = _summed(np.concatenate(h), np.concatenate(c))
                    if len(x) > _HELD // 2:
                        yield _packed(x, n, buckets)
                        x, n = x[:0], n[:0]
                    h, c, held = [x], [n], len(x)
        yield _packed(*_summed(np.concatenate(h), np.concatenate(c)), buckets)

    return run


def _by_bucket(batches):
    """Each bucket's rows, of a partition sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def _whole(batches):
    for b, rows in _by_bucket(batches):
        h, c = _summed(np.frombuffer(b"".join(r[0] for r in rows), np.uint64), np.frombuffer(b"".join(r[1] for r in rows), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([len(h)]), pa.array([int(c.sum())])], names=["bucket", "tokens", "counts", "types", "total"])


def _top(most: int):
    def run(batches):
        for _, rows in _by_bucket(batches):
            h, c = np.frombuffer(rows[0][0], np.uint64), np.frombuffer(rows[0][1], np.int64)
            best = np.lexsort((h, -c, h != END))[:most]  # the end is always on the list
            yield pa.RecordBatch.from_arrays([pa.array(h[best].view(np.int64)), pa.array(c[best])], names=["token", "c"])

    return run


# -------------------------------------------------------------------- network


@dataclass
class Head:
    """The frequent words: hashes in order with their counts, and the number of each in the network (its last for all others)."""

    token: np.ndarray
    count: np.ndarray
    number: np.ndarray
    unknown: int
    end: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 for words not here) and number in the network."""
        if not len(self.token):
            return np.zeros(len(h), np.int64), np.where(h == END, self.end, self.unknown).astype(np.int32)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        hit = self.token[at] == h
        number = np.where(hit, self.number[at], self.unknown).astype(np.int32)
        number[h == END] = self.end
        return np.where(hit, self.count[at], 0), number


def _sum_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted key, and the sums of their rows."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(rows, at, axis=0) if len(at) else rows[:0]


class Network:
    """Gated recurrent network over word numbers, with its output softmax factored into classes.

    Words are numbered by class: class c has the numbers cut[c] to cut[c + 1].
    """

    def __init__(self, frequency: np.ndarray, classes: int = CLASSES, state: int = STATE, seed: int = 1):
        rng = np.random.RandomState(seed)
        k, d = len(frequency), state
        root = np.cumsum(np.sqrt(frequency + 1.0))
        of = np.minimum((root - root[0] * 0.5) / root[-1] * classes, classes - 1).astype(np.int64)
        self.cut = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), k]
        self.of = np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut))
        mass = np.add.reduceat(frequency + 1.0, self.cut[:-1])
        f = np.float32
        self.p = {
            "x": (rng.randn(k, 3 * d) * 0.1).astype(f), "u": (rng.randn(d, 3 * d) / np.sqrt(d)).astype(f), "b": np.r_[np.ones(d), np.zeros(2 * d)].astype(f),
            "cw": np.zeros((d, len(mass)), f), "cb": np.log(mass / mass.sum()).astype(f), "ww": np.zeros((k, d), f), "wb": np.log((frequency + 1.0) / mass[self.of]).astype(f),
        }
        self.state = d

    def forward(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of ids (steps, lanes), from h, which a fresh step sets to 0 before it reads.

        Signs are turned in the weights, so that both gates are 1 / (1 + exp(a)) and the news is 2 / (1 + exp(a)) - 1; with keep also (before, gates, news, r's term) of all steps."""
        d = self.state
        sign = np.r_[np.full(2 * d, -1), np.full(d, -2)].astype(np.float32)
        u = self.p["u"] * sign
        x = self.p["x"][ids]
        x += self.p["b"]
        x *= sign
        out = np.empty((*ids.shape, d), np.float32)
        steps = len(ids) if keep else 1
        before, gates, news, inner = (np.empty((steps, ids.shape[1], k), np.float32) for k in (d, 2 * d, d, 3 * d))
        any_fresh = fresh.any(1).tolist()
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
            for t in range(len(ids)):
                k = t if keep else 0
                a, g, n = inner[k], gates[k], news[k]
                if any_fresh[t]:
                    h = np.where(fresh[t][:, None], np.float32(0), h)
                if keep:
                    before[t] = h
                np.matmul(h, u, out=a)
                np.add(x[t, :, : 2 * d], a[:, : 2 * d], out=g)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                np.multiply(g[:, d:], a[:, 2 * d :], out=n)
                n += x[t, :, 2 * d :]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                h = np.subtract(h, n, out=out[t])
                h *= g[:, :d]
                h += n
        return out, h, (before, gates, news, inner[:, :, 2 * d :] * np.float32(-0.5))

    def logs(self, h: np.ndarray, y: np.ndarray, back: bool = False):
        """Natural log probability of each word y after the states h; with back also the gradients of its negative sum.

        Rows are put in order of their word once; a class, and a word, is then one stretch. A state gets a last 1 for the
        bias; gradients are those of all exponentials, scaled on the side of the few columns, less those of the words themselves."""
        p, d = self.p, self.state
        order = np.argsort(y, kind="stable")
        y = y[order]
        c = self.of[y]
        h1 = np.ones((len(y), d + 1), np.float32)
        h1[:, :d] = h[order]
        cw, ww = np.concatenate([p["cw"], p["cb"][None]]), np.concatenate([p["ww"], p["wb"][:, None]], 1)
        # states lie within -1 and 1, so the weights bound what they add up to
        safe = max(float(np.abs(cw).sum(0).max()), float(np.abs(ww).sum(1).max())) < 80
        own_c, own_w = np.ascontiguousarray(cw.T)[c], ww[y]
        e = h1 @ cw
        shift = np.zeros(len(y), np.float32) if safe else e.max(1)
        if not safe:
            e -= shift[:, None]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], np.float32)
        out = np.einsum("ij,ij->i", h1, own_c) - shift - np.log(total)
        grad: dict[str, np.ndarray] = {}
        if back:
            inv = (1 / total)[:, None]
            gc = (h1 * inv).T @ e
            dh = (e @ cw[:d].T) * inv
            dh -= own_c[:, :d]
            gw = np.zeros_like(ww)
        # the words of each class: a stretch of rows times a stretch of words, all in one buffer
        size = np.diff(self.cut)
        n = np.where(size > 1, size, 0)[c]
        begin = np.cumsum(n) - n
        many = n > 0
        buffer = np.empty(int(n.sum()), np.float32)
        bounds = np.searchsorted(c, np.arange(len(self.cut)))
        parts = [(slice(i, j), slice(v, w), buffer[b : b + (j - i) * (w - v)].reshape(j - i, w - v)) for i, j, v, w, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), self.cut[:-1].tolist(), self.cut[1:].tolist(), np.r_[begin, 0][bounds[:-1]].tolist(), strict=True) if j > i and w > v + 1]
        high = np.zeros(len(y), np.float32)
        for i, j, s in parts:
            np.matmul(h1[i], ww[j].T, out=s)
            if not safe:
                high[i] = s.max(1)
                s -= high[i][:, None]
        np.exp(buffer, out=buffer)
        within = np.ones(len(y), np.float32)
        within[many] = np.add.reduceat(buffer, begin[many]) if len(buffer) else 1
        out += np.where(many, np.einsum("ij,ij->i", h1, own_w) - high - np.log(within), 0)
        result = np.empty_like(out)
        result[order] = out
        if not back:
            return result
        inv = (1 / within)[:, None]
        scaled, more = h1 * inv, np.zeros_like(dh)
        for i, j, s in parts:
            np.matmul(s.T, scaled[i], out=gw[j])
            np.matmul(s, p["ww"][j], out=more[i])
        more *= inv
        dh += more
        dh[many] -= own_w[many, :d]
        words, sums = _sum_by(y, h1)
        of = self.of[words]
        classes, class_sums = _sum_by(of, sums)
        gc[:, classes] -= class_sums.T
        words, sums = words[size[of] > 1], sums[size[of] > 1]
        gw[words] -= sums
        grad = {"cw": gc[:d], "cb": gc[d], "ww": gw[:, :d], "wb": gw[:, d]}
        dback = np.empty_like(dh)
        dback[order] = dh
        return result, grad, dback

    def step(self, ids, fresh, y, use, h):
        """Log loss and gradients of one window, cut off at its start."""
        d, ut = self.state, np.ascontiguousarray(self.p["u"].T)
        out, last, (before, gates, news, term) = self.forward(ids, fresh, h, keep=True)
        flat = use.ravel()
        logs, grad, dflat = self.logs(out.reshape(-1, d)[flat], y.ravel()[flat], back=True)
        dout = np.zeros((ids.size, d), np.float32)
        dout[flat] = dflat
        dout = dout.reshape(out.shape)
        z, r = gates[:, :, :d], gates[:, :, d:]
        # what the error of a state is multiplied by, for all steps at once
        by_z, by_n = (before - news) * z * (1 - z), (1 - z) * (1 - news * news)
        by_r = term * r * (1 - r)
        dx, inner, dh = np.empty((*ids.shape, 3 * d), np.float32), np.empty((*ids.shape, 3 * d), np.float32), np.zeros_like(h)
        back = np.empty_like(h)
        any_fresh = fresh.any(1)
        for t in range(len(ids) - 1, -1, -1):
            g, a = dx[t], inner[t]
            dh += dout[t]
            np.multiply(dh, by_z[t], out=g[:, :d])
            dn = np.multiply(dh, by_n[t], out=g[:, 2 * d :])
            np.multiply(dn, by_r[t], out=g[:, d : 2 * d])
            a[:, : 2 * d] = g[:, : 2 * d]
            np.multiply(dn, r[t], out=a[:, 2 * d :])
            np.matmul(a, ut, out=back)
            dh *= z[t]
            dh += back
            if any_fresh[t]:
                dh[fresh[t]] = 0
        grad |= {"u": before.reshape(-1, d).T @ inner.reshape(-1, 3 * d)}
        dx = dx.reshape(-1, 3 * d)
        grad["b"] = dx.sum(0)
        order = np.argsort(ids.ravel(), kind="stable")
        return logs, grad, _sum_by(ids.ravel()[order], dx[order]), last


def lanes(off: np.ndarray, many: int) -> list[list[int]]:
    """Rows dealt to lanes, longest first, each to the lane with the least so far."""
    import heapq

    n = np.diff(off)
    heap = [(0, i) for i in range(min(many, len(n)))]
    out: list[list[int]] = [[] for _ in heap]
    for row in np.argsort(-n, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        out[i].append(row)
        heapq.heappush(heap, (load + int(n[row]), i))
    return out


def laid_out(number: np.ndarray, off: np.ndarray, many: int, end: int):
    """(inputs, first steps, outputs, in use, place of each output in number), as steps by lanes, the longest lane first: a text's words follow its start."""
    dealt = [np.concatenate([np.arange(off[r], off[r + 1]) for r in rows]) for rows in lanes(off, many)]
    dealt.sort(key=len, reverse=True)
    where = np.zeros((len(dealt[0]) if dealt else 0, len(dealt)), np.int64)
    use = np.zeros(where.shape, bool)
    for i, p in enumerate(dealt):
        where[: len(p), i], use[: len(p), i] = p, True
    first = np.zeros(len(number), bool)
    first[off[:-1]] = True
    y, fresh = number[where], first[where] & use
    x = np.full_like(y, end)
    x[1:] = y[:-1]
    x[fresh] = end
    return x, fresh, y, use, where


def word_logs(net: Network, number: np.ndarray, off: np.ndarray, end: int, many: int = 512, window: int = 64) -> np.ndarray:
    """Natural log probability of each word after those before it in its row."""
    x, fresh, y, use, where = laid_out(number, off, many, end)
    out, h = np.zeros(len(number)), np.zeros((x.shape[1], net.state), np.float32)
    for t in range(0, len(x), window):
        live = int(use[t].sum())  # lanes only ever end, the last ones first
        a = (slice(t, t + window), slice(0, live))
        states, h, _ = net.forward(x[a], fresh[a], h[:live])
        flat = use[a].ravel()
        out[where[a].ravel()[flat]] = net.logs(states.reshape(-1, net.state)[flat], y[a].ravel()[flat])
    return out


def mixed(logs: np.ndarray, counted: np.ndarray, weight: float) -> np.ndarray:
    """Natural log of the network's probabilities, of that weight, and the counted ones together."""
    p = np.exp(logs)
    p *= weight
    p += (1 - weight) * counted
    return np.log(p, out=p)


def score(net: Network, number: np.ndarray, off: np.ndarray, end: int, counted: np.ndarray | None = None, weight: float = 1.0, **how) -> np.ndarray:
    """Natural log probability of each row, mixed with the counted probability of each number if there is one."""
    out = word_logs(net, number, off, end, **how)
    return np.add.reduceat(out if counted is None else mixed(out, counted[number], weight), off[:-1])


class Trainer:
    """Adagrad over windows of LANES lanes. A text stays in its lane to its end, and its state with it."""

    def __init__(self, net: Network, rate: float = 0.1):
        self.net, self.rate, self.seen = net, rate, 0
        self.sums = {k: np.full(v.shape, 1e-2, np.float32) for k, v in net.p.items()}

    def _move(self, k: str, g: np.ndarray, rows=slice(None)) -> None:
        sums = self.sums[k][rows] + g * g
        self.sums[k][rows] = sums
        g *= -self.rate
        g /= np.sqrt(sums, out=sums)
        self.net.p[k][rows] += g

    def texts(self, number: np.ndarray, off: np.ndarray, end: int, many: int = LANES, window: int = WINDOW) -> None:
        x, fresh, y, use, _ = laid_out(number, off, many, end)
        h = np.zeros((x.shape[1], self.net.state), np.float32)
        for t in range(0, len(x), window):
            live = int(use[t].sum())
            a = (slice(t, t + window), slice(0, live))
            logs, grad, (rows, dx), h = self.net.step(x[a], fresh[a], y[a], use[a], h[:live])
            n = np.float32(max(1, len(logs)) ** -0.5)
            for k, g in grad.items():
                g *= n
                self._move(k, g)
            self._move("x", np.clip(dx * n, -1, 1), rows)
            self.seen += len(logs)


def _pages(batches):
    """Sums of the task's weights, a page of 4,096 numbers a row."""
    sums: dict[int, list] = {}
    for batch in batches:
        for page, blob, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.frombuffer(blob, np.float64)
            if page in sums:
                sums[page][0] = sums[page][0] + v
                sums[page][1] += w
            else:
                sums[page] = [v, w]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1] for s in sums.values()], pa.float64())], names=["page", "blob", "w"])


def _train(sent, head):
    def run(batches):
        trainer, number, off, held = Trainer(sent.value), [], [np.zeros(1, np.int64)], 0

        def learn():
            trainer.texts(np.concatenate(number), np.concatenate(off), head.value.end)

        for batch in batches:
            for part in shared.pieces(batch, 8 << 20):
                h, o = tokens(part)
                number.append(head.value.find(h)[1])
                off.append(o[1:] + held)
                held += len(h)
                if held >= AT_ONCE:  # lanes last long, so that one long text does not outlast them
                    learn()
                    number, off, held = [], off[:1], 0
        if held:
            learn()
        if trainer.seen:
            flat = np.concatenate([trainer.net.p[k].ravel() for k in sorted(trainer.net.p)]).astype(np.float64) * trainer.seen
            pages = [flat[a : a + 4096].tobytes() for a in range(0, len(flat), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(pages, pa.binary()), pa.array([float(trainer.seen)] * len(pages), pa.float64())], names=["page", "blob", "w"])

    return run


def set_aside(key: str = "doc_id") -> Column:
    """Whether the network leaves a training text to the choice of its weight."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), "text", F.lit("aside")), F.lit(ASIDE)) == 0


def _weighed(sent, head, counted: np.ndarray):
    """Sums over the task's texts of their log probabilities under each of WEIGHTS."""

    def run(batches):
        sums = np.zeros(len(WEIGHTS))
        for batch in batches:
            for part in shared.pieces(batch, 8 << 20):
                h, off = tokens(part)
                number = head.value.find(h)[1]
                logs = word_logs(sent.value, number, off, head.value.end)
                sums += [mixed(logs, counted[number], w).sum() for w in WEIGHTS]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums))), pa.array(sums)], names=["at", "total"])

    return run


def best_weight(docs: DataFrame, sent, sent_head, counted: np.ndarray) -> float:
    """The weight of the network under which docs are most probable, the least of equals; 0.5 without docs."""
    totals = docs.select("text").mapInArrow(_weighed(sent, sent_head, counted), "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    best = max(totals, key=lambda r: (r.total, -r["at"]), default=None)
    return 0.5 if best is None or best.total == 0 else float(WEIGHTS[best["at"]])


def train(docs: DataFrame, head: Head, net: Network, rounds: int = ROUNDS, key: str = "doc_id") -> Network:
    """The network after rounds of local training and averaging; each text is read once. Weights are summed a page (4,096 numbers) at a time on the executors."""
    spark = docs.sparkSession
    sent_head = spark.sparkContext.broadcast(head)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(net)
        part = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(rounds)) == r).select("text")
        pages = part.mapInArrow(_train(sent, sent_head), "page long, blob binary, w double").repartition(shared.tasks(spark), "page").mapInArrow(_pages, "page long, blob binary, w double").collect()  # as many numbers as the network has
        if pages:
            flat = np.concatenate([np.frombuffer(p.blob, np.float64) / p.w for p in sorted(pages, key=lambda p: p.page)]).astype(np.float32)
            at = 0
            for k in sorted(net.p):
                n = net.p[k].size
                net.p[k] = flat[at : at + n].reshape(net.p[k].shape)
                at += n
    return net


def _scored(sent, head, buckets: int, counted: np.ndarray, weight: float):
    """A row for each text, and rows (bucket, tokens, counts, contents) of its words that are not frequent."""

    def run(batches):
        top = head.value
        for batch in batches:
            for part in shared.pieces(batch, 16 << 20):
                (h, off), content = tokens(part), part.column(2).to_numpy(zero_copy_only=False)
                count, number = top.find(h)
                logs = score(sent.value, number, off, top.end, counted, weight)
                rare = (count == 0) & (h != END)
                unknown = (number == top.unknown) & (h != END)
                known = np.log10(count + 1.0)
                cols = [np.diff(off), np.add.reduceat(count > 0, off[:-1], dtype=np.int64), np.add.reduceat(known, off[:-1]), np.add.reduceat(np.where(unknown, known, 0), off[:-1]), np.add.reduceat(unknown, off[:-1], dtype=np.int64), logs / np.log(10), content]
                none = pa.nulls(len(content), pa.int64())
                blank = pa.nulls(len(content), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols), none, blank, blank, blank], names=_NAMES)
                _, once = np.unique(content, return_index=True)  # copies say the same
                first = np.zeros(len(content), bool)
                first[once] = True
                rare &= np.repeat(first, np.diff(off))
                owner = np.repeat(content, np.diff(off))[rare]
                b, t = (h[rare] % np.uint64(buckets)).astype(np.int64), h[rare]
                order = np.lexsort((owner, t, b))
                b, t, owner = b[order], t[order], owner[order]
                new = np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])] if len(t) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                n = np.diff(np.r_[at, len(t)]).astype(np.int32)
                b, t, owner = b[at], t[at], owner[at]
                if len(b):
                    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                    ends = np.r_[cut[1:], len(b)]
                    blob = lambda x, cut=cut, ends=ends: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
                    nulls = [pa.nulls(len(cut), t) for t in (part.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*nulls, pa.array(b[cut]), blob(t), blob(n), blob(owner)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_tokens", "top_known", "top_log", "top_unknown_log", "n_unknown", "net_log", "content", "bucket", "tokens", "counts", "contents"]
_SCHEMA = "n_tokens long, top_known long, top_log double, top_unknown_log double, n_unknown long, net_log double, content long, bucket long, tokens binary, counts binary, contents binary"


def _found(batches):
    """(content, rare_known, rare_log): what the counts of a bucket say of the rare words in each text."""
    for _, rows in _by_bucket(batches):
        have = [r for r in rows if r[3] is None]
        ask = [r for r in rows if r[3] is not None]
        if not ask:
            continue
        h, c = (np.frombuffer(b"".join(r[i] for r in have), k) for i, k in ((0, np.uint64), (1, np.int64)))
        t, n, owner = (np.frombuffer(b"".join(r[i] for r in ask), k) for i, k in ((0, np.uint64), (1, np.int32), (3, np.int64)))
        order = np.lexsort((t, owner))
        t, n, owner = t[order], n[order], owner[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])]  # copies of a text say the same
        t, n, owner = t[new], n[new], owner[new]
        count = np.zeros(len(t), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, t), len(h) - 1)
            count = np.where(h[at] == t, c[at], 0)
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(owner[cut]), pa.array(np.add.reduceat(n * (count > 0), cut).astype(np.int64)), pa.array(np.add.reduceat(n * np.log10(count + 1.0), cut))], names=["content", "rare_known", "rare_log"])


def language_scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", head_words: int = HEAD, vocabulary: int = VOCABULARY, classes: int = CLASSES, state: int = STATE, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score; training says which rows are learned from."""
    spark = docs.sparkSession
    n_tasks, kind = shared.tasks(spark), dict(docs.dtypes)[key]
    buckets = 4 * n_tasks
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = d.where("training")
    counts = learn.select("text").mapInArrow(_count(buckets), "bucket long, tokens binary, counts binary").repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    counts = shared.written(counts.mapInArrow(_whole, "bucket long, tokens binary, counts binary, types long, total long"), "counts")
    n, v = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    top = counts.select("bucket", "tokens", "counts").mapInArrow(_top(2 * head_words // buckets + 1), "token long, c long").orderBy(F.col("token") != int(END.view(np.int64)), F.desc("c"), "token").limit(head_words).toPandas()
    token, count = top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    in_net = np.flatnonzero(token != END)[: vocabulary - 2]
    ends = int(count[token == END].sum())
    rest = n - ends - int(count[in_net].sum())  # training tokens of all words beyond the network
    frequency = np.r_[count[in_net], ends, rest].astype(float)
    order = np.argsort(-frequency, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    of = np.full(len(token), number[-1])
    of[in_net] = number[:-2]
    by = np.argsort(token)
    head = Head(token[by], count[by], of[by], int(number[-1]), int(number[-2]))
    net = train(learn.where(~set_aside()), head, Network(frequency[order], classes, state), rounds, "doc_id")
    sent, sent_head = spark.sparkContext.broadcast(net), spark.sparkContext.broadcast(head)
    beyond = rest + (v - len(in_net) - (ends > 0)) + 1  # what the counts give to the words beyond the network
    counted = np.r_[frequency[:-2] + 1, ends + 1, beyond][order]
    counted /= counted.sum()
    weight = best_weight(learn.where(set_aside()), sent, sent_head, counted)
    rows = shared.written(d.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")).mapInArrow(_scored(sent, sent_head, buckets, counted, weight), f"doc_id {kind}, {_SCHEMA}"), "scored")
    ask = rows.where("bucket is not null").select("bucket", "tokens", "counts", F.lit(1).alias("kind"), "contents")
    have = counts.select("bucket", "tokens", "counts", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("contents"))
    rare = ask.unionByName(have).repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_found, "content long, rare_known long, rare_log double")
    rare = rare.groupBy(F.col("content").alias("text_key")).agg(F.sum("rare_known").alias("rare_known"), F.sum("rare_log").alias("rare_log"))
    out = rows.where("n_tokens is not null").join(rare, F.col("content") == F.col("text_key"), "left").na.fill(0, ["rare_known", "rare_log"])
    unseen = float(np.log10(beyond))
    return out.select(
        "doc_id", "n_tokens", (F.col("top_known") + F.col("rare_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("top_log") + F.col("rare_log") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("net_log") + F.col("top_unknown_log") + F.col("rare_log") - F.col("n_unknown") * unseen).alias("score"),
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def op2_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_scores(docs, ~held_out())
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
