"""Whitening against a dense eigensolver, and exact deviations against whole numbers of Python."""

import numpy as np
import pytest

from wingtally.llm import whitening as wh


def plain(vectors, components=16):
    width = max(map(len, vectors))
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors]
    fit = [list(v) for v in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    every = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    return n, deviation, every @ basis / np.sqrt(values), values / np.trace(cov)


def compare(got, ids, vectors):
    n, deviation, white, share = plain(vectors)
    table = {}
    for r in got:
        table.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(ids) * white.shape[1] and {r["n"] for r in got} == {n}
    signs = {}
    for i, d, w in zip(ids, deviation, white):
        for r in table[i]:
            k = r["component"] - 1
            assert r["deviation"] == d and abs(r["explained"] - share[k]) <= 1e-9 and r["identity_error"] < 1e-9 and r["residual"] <= 1e-12
            if abs(w[k]) > 1e-3:
                signs.setdefault(k, np.sign(w[k] * r["whitened"]))
                assert r["whitened"] * signs[k] == pytest.approx(w[k], rel=1e-6, abs=1e-7)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    got = wh.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    compare(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_odd_rows(spark):
    draw = np.random.RandomState(3)
    good = [[float(c) for c in draw.standard_normal(20) * np.arange(1, 21)] for _ in range(60)]
    good += [good[0], good[1][:7], [], [c + 1e-6 for c in good[2]]]
    bad = [None, [1.0, None], [float("nan")] * 20, [float("inf")] * 3]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(good + bad)], "vec_id int, embedding array<double>, n int, x string")
    got = wh.whitened(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]
    compare(got.collect(), range(len(good)), good)
    assert wh.whitened(df.where("false")).count() == 0
    assert wh.whitened(df.where("vec_id = 0")).count() == 0  # one vector varies in no direction
    few = df.where("vec_id < 3")
    assert sorted({r["component"] for r in wh.whitened(few).collect()}) == [1, 2]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert {r["deviation"] is None for r in wh.whitened(huge).collect()} == {True}


def test_iteration_where_the_space_is_not_whole():
    draw = np.random.RandomState(4)
    basis = np.linalg.qr(draw.standard_normal((300, 300)))[0]
    values = np.r_[np.linspace(50, 20, 16), 19.9 * 0.98 ** np.arange(284)]
    a = basis * values @ basis.T
    got, vectors, error = wh.leading(lambda b: a @ b, 300, 16)
    assert np.allclose(got, values[:16], rtol=1e-12) and error <= 1e-12
    assert np.allclose(np.abs(vectors.T @ basis[:, :16]), np.eye(16), atol=1e-9)


def test_means_far_from_zero(spark):
    fit = wh.Fit(wh.scaled(spark.createDataFrame([(i, [i * 0.5, 1e6 + i % 3]) for i in range(50)], "vec_id int, embedding array<double>")).select("x"))
    x = np.array([[np.floor(32 * i) + 1e6, np.floor(64 * (1e6 + i % 3)) + 1e6] for i in range(50)])
    assert np.allclose(fit.product(np.eye(2)), np.cov(x.T, bias=True), rtol=1e-12)
