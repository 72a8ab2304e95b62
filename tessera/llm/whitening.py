"""Embedding whitening: the leading principal components of all vectors, scaled to unit variance.

Entries become whole numbers, ``x = floor(1024 * c) + 100000``, so counts and sums are exact; covariances are sums of
products of centred values, taken as blocks by task and added up by Spark.  The covariance matrix (dimensions squared,
whatever the number of rows) is solved by FEAST:

1. Intervals.  The inertia of ``V - s`` (signs of a pivoted LDL' factorisation) counts the eigenvalues above ``s``;
   bisection cuts the spectrum from the top into intervals of a few eigenvalues until the wanted ones are covered.
2. Contour integration.  A circle around an interval, Gauss-Legendre nodes on its upper half: the weighted sum of the
   complex shifted solves ``(z - V) Q = Y`` projects a block of vectors onto the interval's eigenspace.
3. Rayleigh-Ritz on the orthonormal block gives values and vectors; repeated until the residuals are at rounding level.
4. The number found must equal the interval's inertia count.  If not, block and quadrature grow and the step repeats.

Rows whose vector is null or holds null or non-finite entries are dropped; so are vectors of another length than the
most frequent one (ties: the longer), which have no entry for each dimension.  Components without variance (below
rounding level of the largest) do not exist, so a table of one row or of equal vectors gives no rows.  Repeated rows and
ids are rows of their own.  Entries beyond 2**52 in size count as 2**52; a ``deviation`` beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 52
WIDE = 64  #: columns of a matrix block
BATCH = 4096  #: rows handled at once


# -- rows -----------------------------------------------------------------------------------------------------------
def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with finite entries only, their lengths, and those entries as whole numbers, one behind the other."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lens)), lens)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(values)], minlength=len(lens)) == 0)
    x = np.clip(np.floor(values[ok[row]] * SCALE) + SHIFT, -LIMIT, LIMIT).astype(np.int64)
    return np.flatnonzero(ok), lens[ok], x


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of vectors with ``dims`` entries and the entries; the vectors are the last column."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            rows, lens, x = _usable(batch.column(batch.num_columns - 1))
            right = lens == dims
            if right.any():
                yield batch.take(pa.array(rows[right])), x[np.repeat(right, lens)].reshape(-1, dims)


def _fits(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    return n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0) < 1 << 62


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact."""
    return n * x - sums.astype(np.int64) if _fits(x, n, sums) else n * x.astype(object) - sums


def deviations(scaled: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exact; None beyond a long."""
    if scaled.dtype != object and scaled.shape[1] * int(np.abs(scaled).max(initial=0)) ** 2 < 1 << 63:
        return (scaled * scaled).sum(axis=1).tolist()
    return [d if d < 1 << 63 else None for d in (scaled.astype(object) ** 2).sum(axis=1).tolist()]


# -- eigenvalues ----------------------------------------------------------------------------------------------------
def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDL' with complete (Bunch-Parlett) pivoting."""
    m = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(m):
        size = np.abs(m)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        off = size - np.diag(diagonal)
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[r] >= 0.6404 * off[p, q]:
            if diagonal[r] == 0:
                break  # nothing but zeros is left
            rest = np.delete(np.arange(len(m)), r)
            positive += int(m[r, r] > 0)
            c = m[rest, r]
            m = m[np.ix_(rest, rest)] - np.outer(c, c / m[r, r])
        else:
            rest = np.delete(np.arange(len(m)), [p, q])
            positive += 1  # a block of two with a dominant off-diagonal has one value of each sign
            c = m[np.ix_(rest, [p, q])]
            m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(m[np.ix_([p, q], [p, q])], c.T)
    return positive


def project(matrix: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int) -> np.ndarray:
    """The block's part in the eigenspace of the interval, by quadrature over the upper half of a circle around it."""
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    unit = np.eye(len(matrix))
    out = np.zeros_like(block)
    for t, w in zip(points, weights):
        turn = radius * np.exp(0.5j * np.pi * (t + 1))
        out += (0.5 * w * turn * np.linalg.solve((middle + turn) * unit - matrix, block.astype(complex))).real
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, count: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high] and their vectors."""
    n = len(matrix)
    floor = 8 * np.finfo(float).eps * size * np.sqrt(n)
    width, nodes = min(n, 2 * count + 4), 8
    while True:
        block = np.random.default_rng(n + count).standard_normal((n, width))
        last = np.inf
        for _ in range(40):
            u, s, _ = np.linalg.svd(project(matrix, low, high, block, nodes), full_matrices=False)
            basis = u[:, s > s[0] * 1e-14]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            residual = np.linalg.norm(matrix @ block - block * values, axis=0)
            inside = (values > low) & (values <= high) & (residual < 1e-6 * size)
            worst = residual[inside].max(initial=0)
            if inside.sum() == count and (worst <= floor or worst > last / 2 and worst <= 1e3 * floor):
                return values[inside], block[:, inside]
            last = worst if inside.sum() == count else np.inf
        if width == n and nodes >= 64:
            raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}], {int(inside.sum())} were found")
        width, nodes = min(n, 2 * width), min(64, 2 * nodes)


def leading(matrix: np.ndarray, k: int, per_interval: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding level, falling, and their unit vectors (columns)."""
    n = len(matrix)
    size = float(min(np.abs(matrix).sum(axis=1).max(initial=0), np.trace(matrix)) if n else 0)
    none = np.zeros(0), np.zeros((n, 0))
    if size <= 0:
        return none
    top, bottom = size * (1 + 1e-9), 64 * n * np.finfo(float).eps * size
    found: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0
    todo = [(bottom, top, count_above(matrix, bottom), 0)]  # interval, eigenvalues above its ends
    while todo and have < k:
        low, high, above_low, above_high = todo.pop()
        count = above_low - above_high
        if not count:
            continue
        if count > per_interval and high - low > 1e-9 * size:
            middle = low + 0.4871 * (high - low)  # ends that are no simple fractions seldom meet an eigenvalue
            above = count_above(matrix, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
            continue
        found.append(in_interval(matrix, low, high, count, size))
        have += count
    if not found:
        return none
    values, vectors = np.concatenate([v for v, _ in found]), np.concatenate([x for _, x in found], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], vectors[:, order]


# -- fit and transform ----------------------------------------------------------------------------------------------
@dataclass
class Model:
    """Size bounded by the dimensions: sums, components (columns) and their shares."""

    n: int
    sums: np.ndarray  #: of Python integers
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (_scaled(x, self.n, self.sums) / self.n).astype(float) @ (self.components / np.sqrt(self.values))


def moments(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums per dimension of the vectors of the most frequent length."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        total: dict[int, list] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                _, lens, x = _usable(whole.slice(at, BATCH).column(0))
                for size in np.unique(lens).tolist():
                    part = x[np.repeat(lens == size, lens)].reshape(-1, size) if size else np.zeros((int((lens == 0).sum()), 0), np.int64)
                    small = int(np.abs(part).max(initial=0)) < 1 << 48
                    sums = part.sum(axis=0) if small else part.astype(object).sum(axis=0)
                    n, s = total.get(size, (0, 0))
                    total[size] = [n + len(part), s + sums.astype(object)]
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([size], pa.int64()), "n": pa.array([n], pa.int64()),
                                              "sums": pa.array([[str(v) for v in s.tolist()]], pa.list_(pa.string()))})

    parts = vectors.mapInArrow(kernel, "dims long, n long, sums array<string>")
    cells = parts.select("dims", "n", F.posexplode_outer("sums").alias("at", "s"))
    sums = cells.groupBy("dims", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    first = sums.groupBy("dims").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    if first is None or not first.dims:
        return 0, np.zeros(0, object)
    rows = sums.where(F.col("dims") == first.dims).select("at", "s").collect()  # one per dimension
    return int(first.n), np.array([int(r.s) for r in sorted(rows, key=lambda r: r.at)], object)


def _gram(vectors: DataFrame, width: int, dims: int, of_rows) -> np.ndarray:
    """Sum of outer products of the rows ``of_rows`` makes of the vectors: one block row per task, line and WIDE columns."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, -(-width // WIDE) * WIDE))
        for _, x in _matrices(batches, dims):
            y = of_rows(x)
            total[:, :width] += y.T @ y
        if total.any():
            cells = total.reshape(-1, WIDE)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(cells)), pa.int32()), "cells": pa.array(list(cells), pa.list_(pa.float64()))})

    parts = vectors.mapInArrow(kernel, "at int, cells array<double>")
    rows = parts.groupBy("at").agg(F.array(*[F.sum(F.get("cells", F.lit(j))) for j in range(WIDE)]).alias("cells")).collect()
    out = np.zeros((width, -(-width // WIDE) * WIDE)).reshape(-1, WIDE)
    for r in rows:  # width squared cells
        out[r["at"]] = r["cells"]
    return out.reshape(width, -1)[:, :width]


def fit(embeddings: DataFrame, k: int = 8, column: str = "embedding") -> Model:
    """The first ``k`` components of all vectors of the table."""
    vectors = embeddings.select(F.col(column).alias("_v"))
    n, sums = moments(vectors)
    dims = len(sums)
    if not n or not dims:
        return Model(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    covariance = _gram(vectors, dims, dims, lambda x: (_scaled(x, n, sums) / n).astype(float)) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading(covariance, k)
    model = Model(n, sums, components, values, float(np.trace(covariance)))
    if len(values):
        model.identity_error = float(np.abs(_gram(vectors, len(values), dims, model.whiten) / n - np.eye(len(values))).max())
    return model


def transform(embeddings: DataFrame, model: Model, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened`` (an entry per component) of each usable row."""
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, deviation long, whitened array<double>")

    def kernel(batches: Iterator[pa.RecordBatch]):
        for rows, x in _matrices(batches, model.dims):
            yield pa.RecordBatch.from_pydict({
                "vec_id": rows.column(0), "deviation": pa.array(deviations(_scaled(x, model.n, model.sums)), pa.int64()),
                "whitened": pa.array(list(model.whiten(x)), pa.list_(pa.float64()))})

    return embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("_v")).mapInArrow(
        kernel, "vec_id long, deviation long, whitened array<double>")


def digests(rows: DataFrame, model: Model) -> DataFrame:
    """What the query returns: a row per vector and component."""
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
