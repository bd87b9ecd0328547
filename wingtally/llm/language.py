"""Language identification: averaged hashed subword embeddings, a linear softmax,
stochastic gradient descent in numpy, and calibrated rejection.

A text is lower-cased; every run of letters becomes a word between blanks, and
the 2- to 4-character pieces of such words are hashed into a table of embeddings.
The mean of a text's embeddings goes through a linear softmax. As the layer is
linear, its product with the table is taken once, and a text costs one look-up
for each piece.

Calibration bears labels that are partly wrong. The share of wrong labels shows
in the texts that the model is surest of; a text is rejected where the error
beyond that share, smoothed over texts of like score, is above a bound. Labels
that support no such bound reject nothing by score, with a warning.

Defined cases: a null text, an empty one or one without any letter gets `und`,
score 0, rejected. An empty table gives an empty result; a model that has seen
no labelled row predicts `und` for all. Of languages with the same score the
first by name is taken. Repeated rows get the same answer each. Other columns
pass through untouched; columns that bear the names of the result are replaced.
Very long texts are read whole, a block at a time.
"""

from __future__ import annotations

import sys
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BUCKETS, DIM, LONGEST = 1 << 16, 12, 4
#: Production settings: labels, and texts of each, at most, that the classifier is fitted on.
LABELS, PER_LABEL = 400, 500
_BLOCK = 1 << 18
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter, with a 0 at either end."""
    code = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "replace"), np.uint32)
    return code * _is_letter()[code]


def subwords(code: np.ndarray, first: int | None = None) -> np.ndarray:
    """Bucket of each piece of 2 to LONGEST characters that starts before `first`,
    BUCKETS where a position starts none. A piece may have the blank of a word's
    edge first or last, and none inside."""
    first = len(code) if first is None else first
    inner, out = code != 0, []
    h = code * _MIX[0]
    ok = np.ones(len(code), bool)
    for k in range(2, LONGEST + 1):
        m = len(code) - k + 1
        if m <= 0:
            break
        if k > 2:
            ok = ok[:m] & inner[k - 2 : k - 2 + m]
        h = (h[:m] ^ code[k - 1 :]) * _MIX[k - 1]
        use = ok[:m] & (inner[:m] | inner[k - 1 :])
        out.append(np.where(use, (h * _MIX[0]) >> np.uint32(16), np.uint32(BUCKETS))[:first])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # (BUCKETS + 1, labels + 2): log-odds of a piece, 1 where training has seen it, 1; the last row is 0
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def sums(self, code: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over all pieces of a normal text; the last is their number."""
        total = np.zeros(self.table.shape[1])
        for a in range(0, max(1, len(code) - 1), _BLOCK):
            # pieces that start in this block; they may reach into the next
            h = subwords(code[a : a + _BLOCK + LONGEST - 1], _BLOCK)
            total += np.ones(len(h), np.float32) @ self.table.take(h, 0, mode="clip")
        return total

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, calibrated probability and rejection of each text."""
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for i, text in enumerate(texts):
            total = self.sums(normal(text)) if text and self.labels else np.zeros(1)
            n = round(total[-1])
            if not n:
                names.append("und")
                continue
            p = softmax(((total[:-2] / n + self.bias) / self.temperature)[None])[0]
            best = int(p.argmax())
            names.append(self.labels[best])
            scores[i] = p[best]
            rejected[i] = p[best] < self.least_score or total[-2] / n < self.least_known
        return names, scores, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def threshold(score: np.ndarray, right: np.ndarray, error: float, least: int = 20) -> float:
    """The least score at which texts are accepted: 0 if all are.

    The labels' own error is that of the surer half. From the surest text on, the
    error beyond it, over the last `least` texts or a twentieth of all and with
    one more wrong text than seen by chance (two standard deviations), may be up
    to one half in such a stretch, and `error` in all texts that are accepted.
    """
    n = len(score)
    if n < 2 * least:
        return 0.0
    order = np.argsort(-score, kind="stable")
    wrong = (~right[order]).astype(float)
    own = wrong[: n // 2].mean()
    spare = lambda k: 2 * np.sqrt((own * (1 - own) + 0.25 / k) / k)
    k = np.arange(1, n + 1)
    total = np.cumsum(wrong)
    size = np.minimum(k, max(least, n // 20))
    near = (total - np.r_[np.zeros(1), total][k - size]) / size
    ok = (total / k - own <= error + spare(k)) & (near - own <= 0.5 * (1 - own) + spare(size))
    last = int(np.flatnonzero(ok)[-1]) if ok.any() else -1
    if last < n // 2:
        warnings.warn("the labels support no least score: none is rejected by score", stacklevel=2)
        return 0.0
    return 0.0 if last == n - 1 else float(score[order[last]])


def train(rows: list[tuple[str, str]], seed: int = 7, pieces: int = 8_000, epochs: int = 2, batch: int = 32, rate: float = 20.0, error: float = 0.01) -> LanguageModel:
    """Fit on `pieces` windows of labelled texts; a fifth of the texts calibrates.

    Calibration takes the temperature with the least log loss on windows, then
    the threshold of score over the calibrating texts, each read whole, and as
    the least share of known pieces one that all but 1 in 1,000 windows reach.
    """
    rng = np.random.RandomState(seed)
    rows = sorted(r for r in rows if r[0] and r[1])
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS + 1, 2), np.float32), np.zeros(0))
    coded = [(normal(t), labels.index(lang)) for t, lang in rows]
    coded = [c for c in coded if c[0].any()]
    rng.shuffle(coded)
    held, fit = coded[: len(coded) // 5], coded[len(coded) // 5 :] or coded

    def windows(docs: list, n: int) -> list:
        out, by = [], {}
        for d in docs:
            by.setdefault(d[1], []).append(d)
        for k in range(n if docs else 0):  # each label has the same share
            group = by[sorted(by)[k % len(by)]]
            code, y = group[rng.randint(len(group))]
            size = rng.randint(20, 300)
            a = rng.randint(max(1, len(code) - size))
            h = subwords(code[a : a + size])
            h = h[h < BUCKETS]
            if len(h):
                out.append((h, y))
        return out

    e = (rng.rand(BUCKETS, DIM).astype(np.float32) - 0.5) / DIM
    w, bias, seen = rng.normal(0, 1, (DIM, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32), np.zeros(BUCKETS, bool)
    data, done = windows(fit, pieces), 0
    total = max(1, epochs * len(data))
    for _ in range(epochs):
        rng.shuffle(data)
        for a in range(0, len(data), batch):
            part = data[a : a + batch]
            lr = rate * (1 - done / total)
            done += len(part)
            size = np.array([len(h) for h, _ in part])
            h, y = np.concatenate([h for h, _ in part]), np.array([y for _, y in part])
            mean = np.add.reduceat(e[h], np.cumsum(size) - size, axis=0) / size[:, None]
            g = softmax(mean @ w + bias).astype(np.float32)
            g[np.arange(len(part)), y] -= 1
            g /= len(part)
            back = np.repeat((g @ w.T) / size[:, None], size, axis=0)
            order = np.argsort(h, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
            e[h[order][at]] -= lr * np.add.reduceat(back[order], at, axis=0)
            w -= lr * (mean.T @ g)
            bias -= lr * g.sum(0)
            seen[h] = True
    model = LanguageModel(labels, np.r_[np.c_[e @ w, seen, np.ones(BUCKETS)], np.zeros((1, len(labels) + 2))].astype(np.float32), bias)
    check = windows(held, 4_000)
    if check:
        sums = np.array([model.table[h].mean(0) for h, _ in check])
        logits, y = sums[:, :-2] + bias, np.array([y for _, y in check])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 4, 40), key=loss))
        whole = np.array([model.sums(code) for code, _ in held])
        p = softmax((whole[:, :-2] / np.maximum(whole[:, -1:], 1) + bias) / model.temperature)
        model.least_score = threshold(p.max(1), p.argmax(1) == np.array([y for _, y in held]), error)
        model.least_known = float(np.quantile(sums[:, -2], 0.001)) * 0.9
    return model


def sample(docs: DataFrame, where: Column, per_label: int, text: str = "text", label: str = "lang", key: str = "doc_id", labels: int = LABELS) -> list[tuple[str, str]]:
    """At most per_label labelled texts of each of the `labels` most frequent labels, picked by a hash of key and text; equal rows are one.

    Counts by label, summed in each task, say below which hash a label's rows may
    be picked; so few more than those picked are shuffled, however many there are.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & where).select(F.col(label).cast("string").alias("label"), F.col(key).alias("key"), F.col(text).alias("text"))
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(labels).collect()
    if not counts:
        return []
    share = spark.createDataFrame([(r.label, min(1.0, 4 * (per_label + 25) / r["count"])) for r in counts], "label string, share double")
    rows = rows.withColumn("hash", F.xxhash64(F.col("key").cast("string"), "text")).join(F.broadcast(share), "label")
    rows = rows.where((F.col("hash") / 2.0**64 + 0.5) < F.col("share")).groupBy("label", "hash").agg(F.min("text").alias("text"))
    by = Window.partitionBy("label").orderBy("hash")
    picked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_label)
    return [(r[0], r[1]) for r in picked.select("text", "label").toLocalIterator()]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the language, its score and whether it is rejected, under the given names."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows: of one size for any input
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in {n.lower() for n in names}]

    def run(batches):
        m = shared_model.value
        for batch in batches:
            found, scores, rejected = m.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*(batch.schema.names[i] for i in kept), *names],
            )

    schema = docs.limit(0).select([docs.columns[i] for i in kept])
    for name, value in zip(names, ("", 0.0, True), strict=True):
        schema = schema.withColumn(name, F.lit(value))
    return docs.mapInArrow(run, schema.schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(sample(docs, ~held_out(), PER_LABEL))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
