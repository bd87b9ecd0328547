import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingtally.llm import language_model as lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.fixture(scope="module")
def network():
    rng = np.random.RandomState(0)
    net = lm.Network(np.sort(rng.randint(1, 100, 30))[::-1].astype(float), classes=4, state=5)
    for k in net.p:
        net.p[k] = (net.p[k] + rng.randn(*net.p[k].shape) * 0.3).astype(np.float32)
    off = np.r_[0, np.cumsum([5, 1, 9, 3])]
    return net, rng.randint(0, 30, off[-1]), off


def test_gradients(network):
    net, number, off = network
    x, fresh, y, use, _ = lm.laid_out(number, off, 2, 3)
    h = np.zeros((2, 5), np.float32)

    def loss():
        return -net.step(x, fresh, y, use, h)[0].sum()

    _, grad, (rows, dx), _ = net.step(x, fresh, y, use, h)
    grad["x"] = np.zeros_like(net.p["x"])
    grad["x"][rows] = dx
    rng = np.random.RandomState(1)
    for k, p in net.p.items():
        way = rng.randn(*p.shape).astype(np.float32)
        way /= np.sqrt((way**2).sum())
        old, step = p.copy(), np.float32(1e-2)
        net.p[k] = old + step * way
        up = loss()
        net.p[k] = old - step * way
        assert (up - loss()) / (2 * step) == pytest.approx(float((grad[k] * way).sum()), abs=2e-2), k
        net.p[k] = old


def test_state_is_carried_and_probabilities_add_up(network):
    net, number, off = network
    one = lm.score(net, number, off, 3, many=1, window=2)
    assert np.allclose(one, lm.score(net, number, off, 3, many=4, window=64), atol=1e-4)
    h = np.random.RandomState(2).randn(1, 5).astype(np.float32)
    total = sum(math.exp(net.logs(h, np.array([w]))[0]) for w in range(30))
    assert total == pytest.approx(1, abs=1e-4)


def test_scores(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(odd.select("doc_id", "text", "lang", "source", "n_chars")).repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {d: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = Counter(w for d, t in rows if not held[d] for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, len(words(t)), sum(count[w] > 0 for w in words(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    got = lm.language_scores(docs, ~lm.held_out(), head_words=50, vocabulary=40, classes=5).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_network_beats_counts_on_held_out_texts(spark):
    rows = [(i, " ".join(f"{a}{i % 2} {b}{i % 2}" for a, b in [("sun", "moon"), ("tree", "leaf"), ("cat", "dog")] * 8)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = lm.language_scores(docs, ~lm.held_out(), vocabulary=100, classes=6).where(lm.held_out()).agg(F.avg("base_score"), F.avg("score")).first()
    assert out[1] > out[0] * 0.7


def test_empty_tables(spark, odd):
    assert lm.language_scores(odd.limit(0), ~lm.held_out()).count() == 0
    none = lm.language_scores(odd, F.lit(False)).collect()
    assert len(none) == odd.count() and {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}


def test_mixed_probabilities_add_up(network):
    net = network[0]
    counted = np.random.RandomState(4).rand(30)
    counted /= counted.sum()
    h = np.random.RandomState(2).randn(1, 5).astype(np.float32)
    logs = np.array([net.logs(h, np.array([w]))[0] for w in range(30)], float)
    assert np.exp(lm.mixed(logs, counted, 0.3)).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(lm.mixed(logs, counted, 0.0), np.log(counted))


@pytest.mark.parametrize("parts", [1, 4, 96])
def test_mixture_beats_counts_on_a_small_corpus(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts)
    out = lm.language_scores(docs, ~lm.held_out()).where(lm.held_out())
    base, score, better = out.agg(F.sum("base_score"), F.sum("score"), F.avg((F.col("score") > F.col("base_score")).cast("double"))).first()
    assert score > base and better > 0.75


def test_weight_is_the_best_of_the_texts_set_aside(spark, network):
    net = network[0]
    head = lm.Head(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 29, 3)
    docs = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(6)], "doc_id long, text string").repartition(3)
    sent, sent_head = (spark.sparkContext.broadcast(x) for x in (net, head))
    likely, unlikely = np.full(30, 1e-4), np.full(30, 1 / 28)
    likely[[3, 29]], unlikely[[3, 29]] = 0.4986, 1e-9
    assert lm.best_weight(docs, sent, sent_head, likely) == lm.WEIGHTS[0]
    assert lm.best_weight(docs, sent, sent_head, unlikely) == lm.WEIGHTS[-1]
    assert lm.best_weight(docs.limit(0), sent, sent_head, likely) == 0.5
