"""Whitening of embeddings by LOBPCG on a covariance that is never formed.

Each entry c is floor(64 c) + 1,000,000 as a whole number. The fit list is each
distinct vector once, written out. The leading eigenvectors of its covariance
come from locally optimal block preconditioned conjugate gradients: a block of
iterates, the block of their residuals and the block of previous directions span
a small space; one pass over the rows multiplies the covariance with an
orthonormal basis of it (centred rows times the block, and their transposes times
that, summed by task), and the Rayleigh-Ritz vectors of that space are the next
iterates. The driver holds blocks of dimensions x columns, and nothing that grows
with the rows. Blocks have spare columns beyond the components asked for, which
hold close eigenvalues apart. The iteration ends where the residuals of all
components, measured anew on the last iterates, are below `tolerance` times
the largest eigenvalue.

Rows are centred before anything is multiplied and without rounding: with p the
whole part of a mean S / n, x - S / n is ((x - p) n - (S - p n)) / n, whole above the line.

Defined cases: vectors that are null or hold null or non-finite entries are
dropped. Vectors shorter than the longest are filled up with entries 0, and
entries whose scaled value is beyond +-2^40 are set to that bound. Repeated rows
and null or repeated ids get their answer each. Components with an eigenvalue of
at most 1e-12 of the trace (constant data, fewer distinct vectors than
components) have no rows, since they cannot be scaled to one. A deviation beyond
a long is null. Equal eigenvalues: any basis of theirs. Other columns of the
input are not returned, so names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SCALE, SHIFT, BOUND = 64, 1_000_000, 2**40
#: Rows that a task multiplies at once.
ROWS = 8192


def scaled(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows whose vector is whole."""
    v = F.transform(vector, lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-1e15)), F.lit(1e15)) * SCALE), F.lit(-BOUND)), F.lit(BOUND)).cast("long") + SHIFT)
    return rows.select(F.col(key).alias("vec_id"), F.col(vector)).where(good).select("vec_id", x.alias("x"))


def _matrices(batches, width: int, column: str = "x"):
    """Columns of lists as matrices of `ROWS` rows at most, with the batch they are of; short lists are filled up."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            lists = part.column(part.schema.get_field_index(column))
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            if (size == width).all():
                yield part, flat.reshape(len(size), width)
            else:
                out = np.full((len(size), width), SHIFT, np.int64)
                row = np.repeat(np.arange(len(size)), size)
                out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                yield part, out


class Centre:
    """Centres rows exactly: n, the whole parts of the means, n times what is left of them."""

    def __init__(self, n: int, pivot: np.ndarray, rest: np.ndarray):
        self.n, self.pivot, self.rest = n, pivot, rest

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n times the centred rows, whole numbers (as objects where they pass 64 bits)."""
        x = x - self.pivot
        if len(x) and float(np.abs(x).max()) * self.n > 2.0**61:
            x = x.astype(object)
        return x * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) / self.n


class Fit:
    """What is known of the fit list: its size, its centre and the trace of its covariance."""

    def __init__(self, rows: DataFrame):
        """rows: column x, each distinct vector once, written out."""
        self.rows = rows
        n, self.width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        self.n = int(n)
        if not self.n:
            return
        sums = self._summed(lambda x: x[None].sum(1), 1, "long")[0].tolist()
        pivot = [s // self.n for s in sums]
        centre = self.centre = Centre(self.n, np.array(pivot, np.int64), np.array([s - p * self.n for s, p in zip(sums, pivot, strict=True)], np.int64))
        self.trace = float(self._summed(lambda x: (centre.centred(x) ** 2).sum()[None, None], 1, "double")[0, 0]) / self.n

    def _summed(self, f, columns: int, kind: str) -> np.ndarray:
        """The sum over all rows of f(matrix), which has `columns` rows; each task sends one list for each."""
        width = self.width

        def run(batches):
            total = None
            for _, x in _matrices(batches, width):
                part = f(x)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(list(total))], names=["at", "parts"])

        parts = self.rows.mapInArrow(run, f"at long, parts array<{kind}>").select("at", F.posexplode("parts").alias("place", "part"))
        found = parts.groupBy("at", "place").agg(F.sum("part").alias("part")).collect()  # columns x dimensions numbers
        out = np.zeros((columns, 1 + max(r["place"] for r in found)), np.int64 if kind == "long" else np.float64)
        for r in found:
            out[r["at"], r["place"]] = r["part"]
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns."""
        centred = self.centre.centred

        def part(x):
            y = centred(x)
            return (y.T @ (y @ block)).T

        return self._summed(part, block.shape[1], "double").T / self.n

    def gram(self, block: np.ndarray) -> np.ndarray:
        """The covariance of the rows projected on a block."""
        centred = self.centre.centred

        def part(x):
            y = centred(x) @ block
            return y.T @ y

        return self._summed(part, block.shape[1], "double") / self.n


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, those of earlier ones first, without directions that they hardly add."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        fresh = u[:, s > 1e-10]
        fresh = fresh - basis @ (basis.T @ fresh)
        basis = np.hstack([basis, fresh / np.linalg.norm(fresh, axis=0)])
    return basis


def leading(product, width: int, components: int, spare: int = 8, tolerance: float = 1e-12, rounds: int = 300, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors and the largest relative residual of a symmetric operator, by LOBPCG.

    product(block) multiplies the operator with a block of orthonormal columns."""
    components = min(components, width)
    size = min(width, components + spare)
    x = np.linalg.qr(np.random.RandomState(seed).standard_normal((width, size)))[0]
    direction = np.zeros((width, 0))
    ax = product(x)
    for _ in range(rounds):
        value = (x * ax).sum(0)
        residual = ax - x * value
        error = np.linalg.norm(residual[:, :components], axis=0).max() / max(abs(value).max(), 1e-300)
        if error <= tolerance:
            return value[:components], x[:, :components], float(error)
        basis = _orthonormal([x, residual, direction])
        image = product(basis)
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        take = vectors[:, np.argsort(-values, kind="stable")[:size]]
        direction = basis[:, x.shape[1] :] @ take[x.shape[1] :]
        x, ax = basis @ take, image @ take
    raise ArithmeticError(f"residual {error:.1e} after {rounds} rounds")


_COLUMNS = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double", "residual": "double"}


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, tolerance: float = 1e-12) -> DataFrame:
    """Per whole row and component: vec_id, component, n, deviation, whitened, explained, identity_error and residual."""
    x = scaled(rows, key, vector)
    kind = dict(x.dtypes)["vec_id"]
    fit = Fit(shared.written(x.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors"))
    values, vectors, residual, off = np.zeros(0), np.zeros((fit.width, 0)), 0.0, 0.0
    if fit.n and fit.trace > 0:
        values, vectors, residual = leading(fit.product, fit.width, components, tolerance=tolerance)
        real = values > 1e-12 * fit.trace
        values, vectors = values[real], vectors[:, real]
        off = float(np.abs(fit.gram(vectors / np.sqrt(values)) - np.eye(len(values))).max())
    width, project, k = fit.width, vectors / np.sqrt(values), len(values)
    if not k:
        return x.where("false").select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in _COLUMNS.items()))
    centre, share = fit.centre, values / fit.trace

    def run(batches):
        for part, x in _matrices(batches, width):
            m, whole = len(x), centre.whole(x)
            if float(np.abs(whole).max()) ** 2 * width < 2.0**62:
                deviation = (whole.astype(np.int64) ** 2).sum(1).tolist()
            else:
                deviation = [d if d < 2**63 else None for d in (whole.astype(object) ** 2).sum(1)]
            y = (whole.astype(np.float64) / centre.n) @ project
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)), pa.array(deviation, pa.int64()).take(again),
                pa.array(y.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, off)), pa.array(np.full(m * k, residual)),
            ], names=["vec_id", *_COLUMNS])

    return x.mapInArrow(run, f"vec_id {kind}, {', '.join(map(' '.join, _COLUMNS.items()))}")


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
