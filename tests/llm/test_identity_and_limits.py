"""Hashes that stand for texts, keys that repeat, labels that are wrong, texts made to be slow."""

import base64
import random
import time
import warnings

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_sets
from tests.llm.test_suffixes import brute as brute_bytes
from wingtally.llm import decontamination, jaccard, language, quality, secrets, shared, suffixes
from wingtally.llm import language_model as lm


def thue_morse(n, a="a", b="b"):
    x = a
    while len(x) < n:
        x += x.translate(str.maketrans(a + b, b + a))
    return x


PAIRS = [(thue_morse(4096, a, b), thue_morse(4096, b, a)) for a, b in ("ab", "xy", "q7")]


def test_hashes_tell_texts_apart():
    for a, b in PAIRS:
        text = pa.array([a, b, a + " " + b, b + " " + a])
        h = shared.Words(text).hashes()
        assert h[0] != h[1] and (h[2:4] == h[:2]).all() and (h[4:6] == h[1::-1]).all()
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(20_000)} | {"\0" * i for i in range(1, 50)}
    assert len(np.unique(shared.Words(pa.array([" ".join(sorted(words))])).hashes())) == len(words)
    data = np.frombuffer("".join(PAIRS[0]).encode() + bytes(range(256)), np.uint8)
    wide = shared.mixed(shared.eights(data))
    for size in (8, 24, 50):
        n = len(data) - size + 1
        h = shared.grams(wide, slice(0, n), size)
        assert len(np.unique(h)) == len({data[i : i + size].tobytes() for i in range(n)})
        assert (h[5:20] == shared.grams(wide, np.arange(5, 20), size)).all()


def test_clashing_hashes_are_compared(monkeypatch):
    rng = np.random.RandomState(3)
    data = rng.randint(97, 99, 400).astype(np.uint8)
    start, owner = np.arange(380), rng.randint(0, 30, 380)
    text = [data[i : i + 12].tobytes() for i in start]
    want = [min(o for t, o in zip(text, owner, strict=True) if t == x) for x in text]
    assert suffixes.least_owner(data, start, owner, 12).tolist() == want
    real = shared.grams
    monkeypatch.setattr(shared, "grams", lambda *a: real(*a) % np.uint64(5))
    assert suffixes.least_owner(data, start, owner, 12).tolist() == want


def test_pairs_in_the_operators(spark):
    rows = [(i, x) for i, x in enumerate(x for p in PAIRS for x in p)] + [(90, " ".join(PAIRS[0])), (91, " ".join(PAIRS[0][::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_sets(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_sets(rows)
    got = suffixes.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_bytes(rows, 50)
    known = {r.doc_id: r.n_known for r in lm.language_scores(docs, docs["doc_id"].isin(0, 90), vocabulary=20, classes=3).collect()}
    assert known == {0: 2, 1: 2, 90: 3, 91: 3} | dict.fromkeys(range(2, 6), 1)


def test_many_texts_without_an_id(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(None, " ".join(word() for _ in range(150))) for _ in range(4000)]
    rows += [(None, t + " end") for _, t in rows[:10]] + [(7, t) for _, t in rows[20:40]] + [(7, rows[3999][1][:700])]
    for run in (jaccard.similar_sets, suffixes.repeated_passages):
        took = []
        for n in (1000, 1000, 4000):
            docs = spark.createDataFrame(rows[-n:], "doc_id long, text string").repartition(8)
            began = time.time()
            assert run(docs).count() == n
            took.append(time.time() - began)
        assert took[2] < 5 * took[1] + 2, (run, took)


def test_texts_of_one_id_keep_their_own_spans(spark):
    a, b, c = ("".join(random.Random(s).choice("abcdefgh ") for _ in range(200)) for s in range(3))
    rows = [(1, a), (1, b), (5, "x" + a), (5, c + b), (5, c), (None, b + "!"), (None, c), (None, c), (3, a)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_bytes(rows, 50)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.sample(docs, ~language.held_out(), 250), [tuple(r) for r in docs.where(language.held_out() & docs["text"].isNotNull() & docs["lang"].isNotNull()).select("text", "lang").collect()]


@pytest.mark.parametrize("flipped", [0, 0.02, 0.05, 0.1])
def test_wrong_labels_reject_few(labelled, flipped):
    fit, check = labelled
    rng = random.Random(7)
    names = sorted({y for _, y in fit})
    model = language.train([(t, rng.choice([n for n in names if n != y]) if rng.random() < flipped else y) for t, y in fit])
    found, _, rejected = model.predict([t for t, _ in check])
    right = np.array([a == y for a, (_, y) in zip(found, check, strict=True)])
    assert right.mean() > 0.97 and rejected[right].mean() < 0.02


def test_threshold():
    rng = np.random.RandomState(0)
    score = rng.rand(2000)
    right = (score > 0.3) | (rng.rand(2000) < 0.2)
    assert 0.25 < language.threshold(score, right, 0.01) < 0.4  # where error begins
    assert language.threshold(score, rng.rand(2000) > 0.05, 0.01) < 0.05  # error of the labels alone
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert language.threshold(score, score < 0.9, 0.01) == 0.0
    assert said or language.threshold(score[:10], right[:10], 0.01) == 0.0


def test_samples_are_bounded(spark):
    docs = spark.range(6000).selectExpr("id % 2 as doc_id", "concat('text ', id % 1500) as text", "concat('l', id % 3) as lang", "id % 1500 as y")
    got = language.sample(docs, docs["doc_id"] >= 0, 100, labels=2)
    assert len(got) == 200 and len({y for _, y in got}) == 2
    got = quality.sample(docs, docs.selectExpr("doc_id", "y / 1500 as quality"), 50)
    assert 0 < len(got) <= 100 and {y for _, y in got} <= {0.0, 1.0}


def test_pipeline_with_clashing_columns(spark, odd):
    docs = odd.selectExpr("*", "'a' as lang_pred", "'b' as Rejected", "1.5 as text_hash_", "'c' as component_id", "2 as _text", "3 as item_id", "'d' as language").withColumnRenamed("score_", "score")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "/root/testdata/sf0.001")
        assert at.columns == docs.columns, name
    assert {(r.lang_pred, r.Rejected, r.score) for r in at.collect()} == {("a", "b", 1)}
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() == at.count()


def openssh(check=b"\1\2\3\4", cut=0):
    part = lambda b: len(b).to_bytes(4, "big") + b
    secret = check + b"\1\2\3\4" + part(b"ssh-ed25519") + part(bytes(32)) + part(bytes(64)) + part(b"me") + b"\1\2\3"
    body = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(part(b"ssh-ed25519") + part(bytes(32))) + part(secret)
    return body[: len(body) - cut]


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


OID = der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d")
KEYS = {
    "RSA": (der(0x30, der(2, b"\0") + der(2, b"\1" * 64) * 8), der(0x30, der(2, b"\0") + der(2, b"\1" * 64) * 7)),
    "PKCS8": (der(0x30, der(2, b"\0") + der(0x30, OID) + der(4, b"x" * 60)), der(0x30, der(2, b"\0") + der(0x31, OID) + der(4, b"x" * 60))),
    "EC": (der(0x30, der(2, b"\1") + der(4, b"k" * 32)), der(0x30, der(2, b"\2") + der(4, b"k" * 32))),
    "OPENSSH": (openssh(), openssh(cut=1)),
    "OPENSSH check": (openssh(), openssh(check=b"\1\2\3\5")),
    "ENCRYPTED": (der(0x30, der(0x30, OID) + der(4, b"c" * 64)), der(0x30, der(0x30, OID) + der(4, b"c" * 64))[:-1]),
}


@pytest.mark.parametrize("kind", KEYS)
def test_key_types(kind):
    label = {"RSA": "RSA ", "PKCS8": "", "EC": "EC "}.get(kind, kind.split()[0] + " ")
    for good, key in zip((True, False), KEYS[kind], strict=True):
        text = f"-----BEGIN {label}PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END {label}PRIVATE KEY-----"
        assert [k for _, _, k in secrets.spans(text.encode()) if k == "pem"] == ["pem"] * good
        if kind != "ENCRYPTED":
            assert [k for _, _, k in secrets.spans(base64.b64encode(key)) if k == "der"] == ["der"] * good


@pytest.mark.parametrize("text", [b"eyJ" * 1_000_000, b"A" * 2_000_000, b"-----BEGIN RSA PRIVATE KEY-----\na: b\n" + b" aaaa\n" * 200_000, b"30" * 500_000, b"token " * 200_000, b"(" + b"eyJh.eyJi." * 20_000])
def test_secrets_in_long_texts(text):
    began = time.time()
    secrets.spans(text)
    assert time.time() - began < 6


def test_periodic_texts():
    matcher = decontamination.Matcher([(1, "abcd " * 40)], 0.05)
    took = []
    for n in (8_000, 32_000):
        began = time.time()
        (found,) = matcher.find("x " + "abcd " * n)
        took.append(time.time() - began)
        assert found[1] == 0 and n * 5 / 210 < found[4] < n * 5 / 185
    assert took[1] < 8 * took[0] + 1


@pytest.mark.parametrize("kind", ["int", "long", "string", "double"])
def test_item_keys(spark, odd, kind):
    bench = spark.createDataFrame([("7", "the cat and the dog sat on the mat"), (None, "le chat et le chien sont sur la table"), (None, None)], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    got = decontamination.matches(odd, bench)
    assert dict(got.dtypes)["item_id"] == dict(bench.dtypes)["item_id"]
    assert sorted((r.doc_id or -1, r.item_id is None) for r in got.collect()) == [(-1, False), (5, False), (5, False), (9, True)]
    only = decontamination.matches(odd, bench.where("item_id is null")).collect()
    assert [(r.doc_id, r.item_id) for r in only] == [(9, None)]


def test_folder_of_a_cluster(spark, monkeypatch):
    class Session:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared.shared_dir(Session).startswith("file:")
