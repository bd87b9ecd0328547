import hashlib
import random

import pyarrow as pa
import pytest

from wingtally.llm import suffixes


def brute(rows, length):
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        smaller = {o[i : i + length] for d, t in rows if d is not None and (doc is None or d < doc) for o in [(t or "").encode()] for i in range(len(o) - length + 1)}
        for i in range(len(data) - length + 1):
            if data[i : i + length] in smaller:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((-1 if doc is None else doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(rng.randint(4, 30))) for _ in range(12)]
    out = [(None, passages[0]), (0, None), (1, ""), (2, "x" * 300), (3, "x" * 120 + "y" + "xy" * 60), (5, passages[1]), (5, passages[1]), (5, passages[2] + passages[1])]
    while len(out) < n:
        t = "".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.3:
            t = rng.choice(out)[1] or ""
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "!", "zz"]) + t[i + rng.choice([0, 1]) :]
        out.append((rng.choice([len(out), len(out) + 1000]), t))
    return out


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 50, 24), (2, 20, 8), (3, 50, 24)])
def test_passages_match_brute_force(spark, seed, length, gram):
    rows = texts(seed, 150)
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, gram=gram).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, length)


def test_odd_rows(spark, odd):
    got = suffixes.repeated_passages(odd).collect()
    assert len(got) == odd.count() and sorted(r.n_removed == r.n_bytes for r in got if r.doc_id == 7) == [True]
    assert suffixes.repeated_passages(odd.limit(0)).count() == 0


def test_bytes_of_ranks_do_not_grow_with_the_buckets():
    rng = random.Random(9)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(text), pa.array(range(40)), pa.array(range(100, 140))], names=["text", "id", "content"])
    out = [pa.Table.from_batches(suffixes._first_round(50, 24, buckets)([batch])) for buckets in (4, 4000)]
    few, many = (sum(len(x or b"") for c in t.column_names[2:] for x in t[c].to_pylist()) for t in out)
    assert many == few and many < 40 * 16 + 8 * 40 * 2000 / 10
