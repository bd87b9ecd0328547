"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over a document's text gives its evidence. Sites then
lend theirs: the mean quality of each host shrinks toward the global mean, and
that of each path toward its host's, by as many pseudo-documents as the spread
between hosts (or between the paths of hosts) asks for, found by moments. The
posterior log-odds of a document are those of its text plus what the posterior
of its path without itself differs from the global prior.

Site sums are partial aggregates, so a host with a third of all rows is summed
where its rows are read. Only scores and keys are shuffled, never texts.

Defined cases: a null text counts as empty; null hosts and paths are sites of
their own. Labels that are null, or of documents that are not there, are left
out; a document labelled twice counts by the mean. Without any label the text's
evidence is 0.5. Repeated rows get the same answer each. Texts are read whole,
however long. Ties: a posterior of just `least` is kept, and of labelled texts
with one hash in the sample the least text stays. Columns of the input other than
the named ones are not read or returned, so their names cannot clash. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .quality_rules import _sums, repeated_words

WORDS, FEATURES = 1 << 16, 14
#: Labelled documents, of each label at most, that the classifier is fitted on.
PER_LABEL = 2_000

_CLASS = {n: np.array([f(chr(i)) if i < 128 else False for i in range(256)]) for n, f in {"upper": str.isupper, "digit": str.isdigit, "mark": lambda c: c in "#*$%&|<>@{}[]\\^~=_+/", "stop": lambda c: c in ".,;:!?"}.items()}


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of shares and sizes, and each word's bucket with the offsets of rows."""
    raw, w = shared.Words(text, lower=False), shared.Words(text)
    h = w.hashes()
    n, size = np.diff(w.off_w), np.diff(w.off)
    length = (w.end - w.start).astype(float)
    per = lambda x, d: x / np.maximum(d, 1)
    mean = per(_sums_f(length, w.off_w), n)
    cols = [np.log1p(n), np.log1p(size), mean, per(_sums_f(length**2, w.off_w), n) ** 0.5 - mean, per(_sums(length > 20, w.off_w), n), per(_sums(repeated_words(w, h, 3), w.off_w), n), per(_sums(w.data == 10, w.off), n)]
    cols += [per(_sums(_CLASS[c][raw.data], w.off), size) for c in _CLASS] + [per(_sums(raw.data >= 0xC2, w.off), size), n < 20]
    key = h ^ shared.mixed(w.doc.astype(np.uint64))
    _, once = np.unique(key, return_index=True)
    first = np.zeros(len(h), bool)
    first[once] = True
    cols.append(per(_sums(first, w.off_w), n))
    return np.stack([np.asarray(c, float) for c in cols], 1), (h >> np.uint64(48)).astype(np.int64), w.off_w


@dataclass
class TextModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, text: pa.Array) -> np.ndarray:
        x, h, off = features(text)
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias + _sums_f(self.words[h], off) / np.maximum(np.diff(off), 1)
        return self.slope * z + self.shift


def _sums_f(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(v)]
    return total[off[1:]] - total[off[:-1]]


def train(rows: list[tuple[str, float]], seed: int = 3, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> TextModel:
    """Logistic regression on (text, label) by mini-batch descent with equal weight for either label; a fifth of the rows calibrates the slope and shift to their true share."""
    if not rows or len({y for _, y in rows}) < 2:
        y = float(np.mean([y for _, y in rows])) if rows else 0.5
        bias = float(np.log((y + 1e-3) / (1 - y + 1e-3)))
        return TextModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros(WORDS), bias)
    rng = np.random.RandomState(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    x, h, n_words = [], [], []
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string())], names=["text"])
    for part in shared.pieces(batch):  # a block at a time, for the driver's memory
        a, b, c = features(part.column(0))
        x.append(a)
        h.append(b.astype(np.int32))
        n_words.append(np.diff(c))
    x, h, off = np.concatenate(x), np.concatenate(h), np.r_[0, np.cumsum(np.concatenate(n_words))]
    y = np.array([v for _, v in rows], float)
    held = np.arange(len(rows)) % 5 == 0
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    weight, words, bias = np.zeros(x.shape[1]), np.zeros(WORDS), 0.0
    balance = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    fit, n = np.flatnonzero(~held), np.maximum(np.diff(off), 1)
    for epoch in range(epochs):
        rng.shuffle(fit)
        lr = rate / (1 + epoch / 8)
        for part in np.array_split(fit, max(1, len(fit) // 64)):
            at = np.concatenate([np.arange(off[i], off[i + 1]) for i in part])
            owner = np.repeat(np.arange(len(part)), n[part] * (np.diff(off)[part] > 0))
            own = np.bincount(owner, words[h[at]], len(part)) / n[part]
            g = (1 / (1 + np.exp(-(z[part] @ weight + bias + own))) - y[part]) * balance[part] / len(part)
            weight -= lr * (z[part].T @ g + decay * weight)
            bias -= lr * g.sum()
            words -= 20 * lr * np.bincount(h[at], (g / n[part])[owner], WORDS)
    model = TextModel(mean, scale, weight, words, bias)
    raw = z[held] @ weight + bias + _sums_f(words[h], off)[held] / n[held]
    a, b = 1.0, 0.0  # Platt scaling, by Newton's method with a weak pull to slope 1
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        v = p * (1 - p) + 1e-9
        grad = np.array([((p - y[held]) * raw).sum() + (a - 1), (p - y[held]).sum()])
        hess = np.array([[(v * raw * raw).sum() + 1, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(max(a, 1e-2)), float(b)
    return model


def evidence(docs: DataFrame, model: TextModel, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns and text_logit, for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of one size for any input
    rows = docs.select(*columns, F.col(text).alias("text"))

    def run(batches):
        at = {}
        for batch in batches:
            at = at or {n: i for i, n in enumerate(batch.schema.names)}
            for part in shared.pieces(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in columns), pa.array(sent.value.logits(part.column(at["text"])), pa.float64())], names=[*columns, "text_logit"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("text_logit", F.lit(0.0)).schema)


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def pseudo_count(mean: Column, prior: Column, n: Column) -> Column:
    """By moments over groups: prior documents k such that group means vary as k asks for.

    Of a group's squared distance to its prior, p(1-p)/n is chance and the rest
    t is spread; k = p(1-p)/t - 1, between 1 and 10,000."""
    chance = F.sum(prior * (1 - prior))
    spread = F.greatest((F.sum(n * F.pow(mean - prior, 2)) - chance) / F.sum(n), F.lit(1e-9))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.sum(n * prior * (1 - prior)) / F.sum(n) / spread - 1))


def classify(docs: DataFrame, labels: DataFrame, model: TextModel, key: str = "doc_id", host: str = "source", path: str = "lang", label: str = "quality", least: float = 0.5) -> DataFrame:
    """Per row of docs: key, text_quality, host_quality, path_quality, quality (the posterior) and kept (quality >= least)."""
    names = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    rows = evidence(names, model, ["doc_id", "host", "path"]).withColumn("text_quality", 1 / (1 + F.exp(-F.col("text_logit"))))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    rows = rows.join(known, rows["doc_id"] == known["k"], "left").withColumn("v", F.coalesce("label", "text_quality")).drop("k", "label")
    rows = shared.written(rows, "evidence")
    paths = shared.written(rows.groupBy("host", "path").agg(F.sum("v").alias("s"), F.count("*").cast("double").alias("n")), "sites")
    whole = paths.agg((F.sum("s") / F.sum("n")).alias("prior"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")).crossJoin(whole)  # one row on the right
    hosts = hosts.crossJoin(hosts.agg(pseudo_count(F.col("hs") / F.col("hn"), F.col("prior"), F.col("hn")).alias("kh")))
    hosts = hosts.withColumn("host_quality", (F.col("hs") + F.col("kh") * F.col("prior")) / (F.col("hn") + F.col("kh"))).select(F.col("host").alias("h"), "host_quality", "prior")
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h")
    paths = paths.crossJoin(paths.agg(pseudo_count(F.col("s") / F.col("n"), F.col("host_quality"), F.col("n")).alias("kp")))
    paths = paths.withColumn("path_quality", (F.col("s") + F.col("kp") * F.col("host_quality")) / (F.col("n") + F.col("kp"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "s", "n", "kp", "host_quality", "path_quality", "prior")
    out = rows.join(paths, rows["host"].eqNullSafe(paths["h"]) & rows["path"].eqNullSafe(paths["p"]), "left")
    others = (F.col("s") - F.col("v") + F.col("kp") * F.col("host_quality")) / (F.col("n") - 1 + F.col("kp"))
    z = F.col("text_logit") + logit(others) - logit(F.col("prior"))
    out = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.select(F.col("doc_id").alias(key), "text_quality", "host_quality", "path_quality", "quality", (F.col("quality") >= least).alias("kept"))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, key: str = "doc_id", label: str = "quality") -> list[tuple[str, float]]:
    """At most per_label texts of either label (below 0.5 or not), by a hash of key and text; equal rows are one.

    Counts by label, summed in each task, say below which hash a row may be picked, so few more than those picked are shuffled with their texts."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y")).select("k", (F.col("y") >= 0.5).cast("double").alias("y"))
    counts = known.groupBy("y").count().collect()
    if not counts:
        return []
    share = spark.createDataFrame([(r.y, min(1.0, 4 * (per_label + 25) / r["count"])) for r in counts], "y double, share double")
    known = known.join(F.broadcast(share), "y").where((F.xxhash64(F.col("k").cast("string")) / 2.0**64 + 0.5) < F.col("share")).select("k", "y")
    rows = docs.where(F.col("text").isNotNull()).select(F.col(key).alias("id"), "text")
    rows = rows.join(F.broadcast(known), rows["id"] == known["k"]).select("k", "y", "text")
    rows = rows.groupBy("y", F.xxhash64(F.col("k").cast("string"), "text").alias("hash")).agg(F.min("text").alias("text"))
    picked = rows.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("hash"))).where(F.col("r") <= per_label)
    return sorted((r[0], r[1]) for r in picked.select("text", "y").toLocalIterator())


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, train(sample(docs, labels, PER_LABEL)))
