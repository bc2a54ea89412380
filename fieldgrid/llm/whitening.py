"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The matrix A holds the distinct vectors x = floor(scale * embedding), centred, a row each. Step k
takes one pass over the rows and gives both of its products: p = A y and the sum of row * p, which
is A'p. Left vectors are never stored: each is A w for a known w, so a row's entries of all left
vectors so far are one small product with the row, and full reorthogonalisation needs no table of
its own. The driver holds matrices of dimension by steps (at most dimension by dimension) and one
row a task comes back summed, whatever the number of rows. A lost executor costs its own tasks.

Rows take part if their vector is neither null nor empty, holds neither null nor non-finite entries
and every floor(scale * entry) fits 64 bits. A null vec_id is kept, repeated rows are each answered.
Vectors of different length are separate fits. A direction without spread (fewer distinct vectors
than dimensions, a constant entry) is no component. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

COMPONENTS = 4
BLOCK = 4096  # rows of the fit list held as one block
CLOSE = 1e-14  # a component has converged below this residual, relative to the largest singular value
FLAT = 1e-12  # singular values below this share of the largest count as no spread
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, x (array<bigint>), dim of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 63)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("x"), F.size("embedding").alias("dim"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(x: DataFrame, dim: int) -> DataFrame:
    """The distinct vectors of one length, ``BLOCK`` rows of 64-bit numbers in one binary value."""

    def pack(batches):
        for batch in batches:
            rows = np.ascontiguousarray(_rows(batch.column(0), dim), np.int64)
            parts = [rows[k : k + BLOCK].tobytes() for k in range(0, len(rows), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["block"])

    return x.select("x").distinct().mapInArrow(pack, "block binary")


def _summed(blocks: DataFrame, dim: int, sums) -> np.ndarray:
    """``sums`` of all rows: it maps rows x to a vector of doubles; one vector a task is shuffled."""

    def run(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0):
                part = sums(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    found = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["at"]] = r["value"]
    return out


def _totals(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the sums of each dimension, exact: 32-bit halves are summed apart, then as decimals."""

    def run(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim)
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(low), pa.array(high)], names=["at", "n", "low", "high"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = blocks.mapInArrow(run, "at int, n long, low long, high long").groupBy("at").agg(*map(exact, ("n", "low", "high"))).orderBy("at").collect()
    return int(found[0]["n"]), [int(r["low"]) + (int(r["high"]) << 32) for r in found]


class Centre:
    """Subtracts S / n: the whole part in integers, the rest in doubles, so no digits of x are lost."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])
        self.wide = any(abs(s // n) >= 1 << 61 for s in sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.wide or np.abs(x).max(initial=0) >= 1 << 61:  # the difference may not fit 64 bits
            return (x.astype(object) - self.whole.astype(object)).astype(np.float64) - self.rest
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; null beyond 64 bits."""
        far = self.n * (float(np.abs(self(x)).max(initial=0)) + 1)
        if far * far * x.shape[1] < 2**62 and self.n * float(np.abs(x).max(initial=0)) < 2**62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _fresh(dim: int, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """A unit vector orthogonal to the columns of ``basis``; None if they span everything."""
    if basis.shape[1] >= dim:
        return None
    v = rng.normal(size=dim)
    for _ in range(3):
        v -= basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(blocks: DataFrame, dim: int, centre: Centre, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the centred rows, and their right vectors as columns.

    Stops when the residuals of all wanted triplets are below ``CLOSE`` and a fresh start vector
    has brought no further copy of one, at the latest when the right vectors span every dimension.
    Products along one Krylov sequence make R bidiagonal; a fresh start adds a column of its own.
    """
    rng = np.random.default_rng(seed)
    V, W, Z = (np.zeros((dim, 0)) for _ in range(3))
    R = np.zeros((0, 0))
    v, beta = _fresh(dim, V, rng), 0.0
    top, checked, since = None, 0, 0
    while v is not None:
        k = V.shape[1]
        y, column = v.copy(), np.zeros(k)
        if beta:
            y -= beta * W[:, k - 1]
            column[k - 1] = beta
        for _ in range(4):

            def products(x, y=y, W=W):
                a = centre(x)
                p = a @ y
                return np.concatenate([[p @ p], a.T @ p, (a @ W).T @ p])

            got = _summed(blocks, dim, products)
            norm2, back, along = got[0], got[1 : 1 + dim], got[1 + dim :]
            column += along
            y -= W @ along
            if along @ along <= 1e-20 * norm2 or norm2 == 0:
                break
        alpha = math.sqrt(max(0.0, norm2 - along @ along))
        R = np.block([[R, column[:, None]], [np.zeros((1, k)), np.full((1, 1), alpha)]])
        V = np.column_stack([V, v])
        largest = np.linalg.norm(R, 2)
        if alpha > FLAT * largest:
            W, Z = np.column_stack([W, y / alpha]), np.column_stack([Z, (back - Z @ along) / alpha])
        else:  # the row space is used up along this sequence: no left vector, and a fresh start
            R[k, k] = 0.0
            W, Z = np.column_stack([W, np.zeros(dim)]), np.column_stack([Z, np.zeros(dim)])
        q = Z[:, k].copy()
        for _ in range(2):
            q -= V @ (V.T @ q)
        beta, since = float(np.linalg.norm(q)), since + 1
        left, sigma, right = np.linalg.svd(R)
        m = min(wanted, k + 1)
        residual = np.linalg.norm((Z - V @ R.T) @ left[:, :m], axis=0)
        if k + 1 >= min(dim, wanted + 1) and (residual <= CLOSE * max(largest, 1e-300)).all() and since > checked:
            if top is not None and np.allclose(top, sigma[:m], rtol=1e-10, atol=FLAT * largest):
                break
            top, checked, since = sigma[:m].copy(), since, 0  # once more from elsewhere: equal values show one copy a sequence
            beta = 0.0
        if beta > FLAT * largest:
            v = q / beta
        else:
            beta, v = 0.0, _fresh(dim, V, rng)
    left, sigma, right = np.linalg.svd(R)
    m = min(wanted, int((sigma > FLAT * max(sigma[0], 1e-300)).sum())) if len(sigma) and sigma[0] > 0 else 0
    return sigma[:m], V @ right[:m].T


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part."""
    rows = whole_numbers(vectors, scale)
    parts = [_whiten(rows.where(F.col("dim") == d), d, components) for (d,) in sorted(map(tuple, rows.select("dim").distinct().collect()))]
    if not parts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _whiten(rows: DataFrame, dim: int, components: int) -> DataFrame:
    blocks = cut(_blocks(rows, dim))
    n, sums = _totals(blocks, dim)
    centre = Centre(n, sums)
    sigma, basis = bidiagonalise(blocks, dim, centre, components)
    m = len(sigma)
    if not m:
        return rows.sparkSession.createDataFrame([], RESULT)
    to_white = basis / (sigma / math.sqrt(n))

    def moments(x):
        a = centre(x)
        w = a @ to_white
        return np.concatenate([[np.einsum("ij,ij->", a, a)], w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(blocks, dim, moments)
    mean, second = got[1 : 1 + m] / n, got[1 + m :].reshape(m, m) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())
    explained = sigma**2 / got[0]

    def answer(batches):
        for batch in batches:
            x = _rows(batch.column(1), dim)
            k = len(x)
            if not k:
                continue
            white = centre(x) @ to_white
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * m, n)),
                    pa.array([d for d in centre.deviation(x) for _ in range(m)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, k)),
                    pa.array(np.full(k * m, error)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(answer, RESULT)
