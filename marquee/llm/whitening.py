"""Whitening of embeddings by shifted CholeskyQR.

Rows are centred by exact sums. A pass over all rows gives their Gram matrix; its Cholesky factor R, of the matrix with a
small shift the first time, makes the rows nearly orthonormal through triangular solves (y R^-1). Two or more further
passes repeat that on the rows as the factors so far leave them, until their Gram matrix is the identity to rounding.
The factors multiply into one R with R^T R = Y^T Y, whose condition was never squared; its singular value decomposition
gives the components. A last pass measures the covariance of the whitened rows.

Each pass reads the rows anew and sends a Gram matrix a task, which is added up row by row; the driver holds matrices of
the dimension squared and nothing that grows with the rows.

Defined results: rows whose vector is null, or has a null or non-finite entry, are left out. Vectors count in the most
frequent dimension (of equally frequent ones the largest); others are left out. Components whose variance is nought
(below 1e-12 of the largest) have no whitened values and give no rows, so an empty table, a single vector or equal
vectors give none. Equal variances: any basis of their space. Repeated rows and null ids are rows like any other. Other
columns are left out. Deviations that pass 64 bits raise an error rather than wrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import ready, slices

#: Vectors a block within a task.
BLOCK = 2048


def _scaled(part: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, floor(1024 c) + 100000."""
    held = np.asarray(part.column(part.num_columns - 1).flatten(), dtype=np.float64)
    return np.floor(1024.0 * held).astype(np.int64).reshape(-1, dimension) + 100_000


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n, from whole numbers: n x - S has no rounding."""
    return (n * x - sums) / float(n)


def _over_rows(vectors: DataFrame, dimension: int, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over blocks of rows of make(block), a matrix: added within a task, then by matrix row over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in slices(batches, BLOCK):
            if part.num_rows:
                one = make(_scaled(part, dimension))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total))], ["i", "line"])

    def add(lines: pa.Table) -> pa.Table:
        return pa.table([lines.column("i").slice(0, 1), pa.array([sum(np.asarray(v.values) for v in lines.column("line"))])], ["i", "line"])

    lines = vectors.select("vector").mapInArrow(run, f"i int, line array<{kind}>").groupBy("i").applyInArrow(add, f"i int, line array<{kind}>").collect()
    return np.array([r["line"] for r in sorted(lines)])  # a row a dimension


def _gram(vectors: DataFrame, sums: np.ndarray, n: int, solve: np.ndarray) -> np.ndarray:
    """The Gram matrix of the centred rows times ``solve``."""

    def block(x: np.ndarray) -> np.ndarray:
        q = _centred(x, sums, n) @ solve
        return q.T @ q

    return _over_rows(vectors, len(sums), block, "double")


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """R, upper, with R^T R = gram + s; s is the least of shift, 10 shift, ... that leaves the matrix positive."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * float(np.trace(gram)))


def factors(vectors: DataFrame, sums: np.ndarray, n: int, most: int = 8) -> np.ndarray:
    """R of all centred rows. Directions without any variance keep to nought, the others end orthonormal."""
    d = len(sums)
    r, solve = np.eye(d), np.eye(d)
    for step in range(most):
        gram = _gram(vectors, sums, n, solve)
        size = float(np.linalg.eigvalsh(gram)[-1])
        if size <= 0:
            return np.zeros((d, d))
        if step >= 2:
            # Each eigenvalue is one, or nought where the rows have no extent.
            away = np.abs(np.linalg.eigvalsh(gram)[:, None] - np.array([0.0, 1.0])).min(axis=1).max()
            if away < 1e-13 * d:
                break
        one = _factor(gram, 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size if step == 0 else 0.0)
        r = one @ r
        solve = np.linalg.solve(r.T, np.eye(d)).T  # R^-1, through the triangle
    return r


class Whitening:
    """What whitening a vector takes. components: unit columns, by falling variance."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray, most: int):
        self.n, self.sums = n, sums
        _, s, v = np.linalg.svd(r)
        variance = s**2 / n
        found = min(most, int(np.sum(variance > 1e-12 * max(variance[0], 1e-300)))) if variance[0] > 0 else 0
        self.components, self.variance = v[:found].T, variance[:found]
        if found:
            self.components = self.components * np.sign(self.components[np.abs(self.components).argmax(axis=0), np.arange(found)])
        self.explained = self.variance / max(float(variance.sum()), 1e-300)  # of all, those left out included
        self.identity_error = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.sums, self.n) @ self.components / np.sqrt(self.variance)


def usable(df: DataFrame, vector_col: str, id_col: str) -> tuple[DataFrame, int]:
    """(id, vector of doubles) of the rows that count, and their dimension (0: none)."""
    ready(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("held"))
    top = sizes.orderBy(F.desc("held"), F.desc("size")).first()
    dimension = top["size"] if top else 0
    return rows.where(F.size("vector") == dimension), dimension


def fit(vectors: DataFrame, dimension: int, most: int = 8) -> Whitening | None:
    """The whitening of all these rows; None without rows."""
    if not dimension:
        return None
    sums = _over_rows(vectors, dimension, lambda x: np.vstack([x.sum(axis=0), np.full(dimension, len(x))]), "bigint")
    n, sums = int(sums[1, 0]), sums[0]
    out = Whitening(n, sums, factors(vectors, sums, n), most)
    if len(out.variance):
        # With the sums, for a covariance is about the mean.
        moments = _over_rows(vectors, dimension, lambda x: np.vstack([(w := out(x)).T @ w, w.sum(axis=0)]), "double")
        mean = moments[-1] / n
        out.identity_error = float(np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact."""
    away = n * x - sums
    if np.any((away.astype(float) ** 2).sum(axis=1) > 9.2e18):
        raise OverflowError("a deviation passes 64 bits")
    return (away * away).sum(axis=1)


def whiten(df: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row a vector and component up to ``most``."""
    vectors, dimension = usable(df, vector_col, id_col)
    model = fit(vectors, dimension, most)
    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variance):
        return df.sparkSession.createDataFrame([], ddl).withColumnRenamed("id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variance)
        for part in slices(batches, BLOCK):
            x = _scaled(part, dimension)
            rows = len(x) * k
            columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(rows, model.n), np.repeat(deviations(x, model.sums, model.n), k), model(x).ravel(), np.tile(model.explained, len(x)), np.full(rows, model.identity_error)]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
