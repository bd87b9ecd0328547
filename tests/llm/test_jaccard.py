import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wingtally.llm import jaccard
from wingtally.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(s), names.get(find(i), -1) if s or d is None else d) for i, (d, s) in enumerate(sets))


def variants(seed, n):
    """Groups of near copies around the threshold, chains among them, with a passage and a line that many share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocab) for _ in range(40)]
    out = [(None, "A b c d e"), (0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "a b c d e"), (5, "other words with that same id here")]
    while len(out) < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        if rng.random() < 0.3:
            base = passage + base[: rng.randint(0, 15)]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            out.append((len(out), " ".join(base)))
    return out


@pytest.mark.parametrize(("seed", "chunk", "frequent"), [(1, 1024, 32), (2, 4, 2), (3, 3, 10**9)])
def test_join_matches_brute_force(spark, monkeypatch, seed, chunk, frequent):
    monkeypatch.setattr(jaccard, "IN_ALL", frequent)
    monkeypatch.setattr(jaccard, "IN_TASK", 2)
    rows = variants(seed, 350)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.similar_sets(docs, chunk=chunk).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)


def test_join_on_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.similar_sets(odd).collect()}
    assert got[(7, got and next(n for d, n in got if d == 7))] == 6 and {d for d, _ in got} == {r.doc_id for r in odd.collect()}
    assert got[(None, 5)] == 5 and got[(1, 0)] == 1 and got[(4, 0)] == 4
    assert jaccard.similar_sets(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in links)}


def numbers(seed):
    rng = random.Random(seed)
    return lambda n: [rng.getrandbits(63) for _ in range(n)]


def test_only_sets_outside_the_largest_component_ask(monkeypatch):
    new = numbers(6)
    base = new(100)
    sets = [np.unique(np.array(base[k:] + new(k), np.uint64)) for k in [2] * 90 + [16] * 10]
    asked, near = [], jaccard.Trie.near
    monkeypatch.setattr(jaccard.Trie, "near", lambda *a: asked.append(1) or near(*a))
    none = np.zeros(0, np.int64)
    links = jaccard.joined(sets, None, 75, jaccard.Order(none.view(np.uint64), none, none))
    linked = {frozenset((i, j)) for i in range(100) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert {frozenset(x) for x in links} <= linked and len(links) == 89 and len(asked) <= 15


def test_sets_of_one_label_fall_into_clusters():
    new = numbers(7)
    a, b = new(200), new(200)
    sets = {9: a, 4: a[5:] + new(5), 3: b, 8: b[5:] + new(5), 1: new(200), 7: a[5:] + new(5), 2: a + new(100)}
    bits = {7: 2}  # came by another shingle than all others
    rows = [(1, k, bits.get(k, 1), len(s), jaccard._sketch(np.array(sorted(s), np.uint64))) for k, s in sets.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["label", "k", "bits", "n", "sketch"])
    got = pa.Table.from_batches(jaccard._possible(75)([batch])).to_pylist()
    assert sorted((r["label"], r["k"]) for r in got) == [(3, 3), (3, 8), (4, 4), (4, 9)]
