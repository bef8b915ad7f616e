"""PCA whitening of embeddings by a matrix-free Jacobi-Davidson method.

The covariance is never formed. It is only applied: one Spark job reads the table of
centred vectors, multiplies each part of it by a block of directions and adds up the
parts' results by dimension. A job returns (dimension x directions) sums to the
driver, whatever the number of vectors.

The eigenpairs come from a subspace that grows by corrections: Rayleigh-Ritz gives the
leading pairs of the subspace; for those whose residual is too large the projected
correction equations are solved by some steps of MINRES, all of them in one
block, so that a step costs one job; pairs whose residual has reached double precision
are locked. A large subspace is restarted from its leading pairs.

Entries c become whole numbers floor(64 * c) + 1000000, their sums are exact, and
n * x - S is exact before it is divided by n.

Defined results: rows whose vector is null, or holds null or non-finite entries, are
dropped; so are those whose vector has not the most frequent number of
entries (of several, the largest). Repeated rows count as often as they occur.
Components of no variance (rank below the number asked for, a single row) are left out: the
arrays are shorter then, and empty where all vectors are equal. An empty table gives an empty
result. Where sums or a deviation exceed 64 bits, ``OverflowError`` is raised. Columns of the
table named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import tidy, written

COMPONENTS = 32
STEPS = 64.0  # whole numbers to a unit
SHIFT = 1_000_000
PRECISION = 1e-13  # of a residual, against the largest eigenvalue
INNER_STEPS = 8
NO_VARIANCE = 1e-12  # of the trace
BLOCK_BYTES = 4 << 20
_NEW = ("n", "deviation", "whitened", "explained", "identity_error")

Product = Callable[[np.ndarray], np.ndarray]


def _minres(apply: Product, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each, by ``steps`` of MINRES in lockstep."""
    norm = lambda m: np.sqrt((m * m).sum(0))
    tiny = np.finfo(float).tiny
    x, w, w_last = (np.zeros_like(right) for _ in range(3))
    y, r1, r2 = right, right, right
    first = beta = norm(right)
    oldb = np.ones_like(beta)
    phibar, cs, sn, dbar, epsln = beta.copy(), -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for step in range(steps):
        alive = (beta > first * 1e-15) & (phibar > enough * first)
        if not alive.any():
            break
        v = np.where(alive, y / np.maximum(beta, tiny), 0.0)
        y = apply(v)
        if step:
            y = y - r1 * (beta / np.maximum(oldb, tiny))
        alfa = (v * y).sum(0)
        y = y - r2 * (alfa / np.maximum(beta, tiny))
        r1, r2 = r2, y
        oldb, beta = beta, norm(y)
        oldeps, delta, gbar = epsln, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w_last, w = w, (v - w_last * oldeps - w * delta) / gamma
        x = x + np.where(alive, w * phi, 0.0)
    return x


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal ``against``."""
    for keep in (1e-10, 0.1):
        lengths = np.sqrt((new * new).sum(0))
        new = new[:, lengths > 0] / lengths[lengths > 0]
        new = new - against @ (against.T @ new)
        if not new.shape[1]:
            return new
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, size > keep]
    return new


def jacobi_davidson(
    product: Product, dimension: int, count: int, precision: float = PRECISION, inner_steps: int = INNER_STEPS, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their eigenvectors, of the symmetric ``product``.

    Leading pairs are locked in order, and the search goes on while the subspace still shows a larger
    value than a locked one, so none is passed over.
    """
    count = min(count, dimension)
    random = np.random.default_rng(seed)
    width, most = min(dimension, count), min(dimension, max(4 * count, count + 8))
    space = np.linalg.qr(random.standard_normal((dimension, width)))[0]
    image = product(space)
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    scale = 0.0
    for _ in range(1000):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max([scale, *np.abs(theta)])
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        lengths = np.sqrt((residual * residual).sum(0))
        full = locked.shape[1] + space.shape[1] >= dimension
        done = np.cumprod((lengths <= precision * scale) | full).sum()
        missed = values.min(initial=np.inf)
        # Beyond the wanted number only a value above a locked one is of interest.
        done = min(int(done), max(count - len(values), int((theta > missed).sum())))
        locked = np.hstack((locked, space[:, :done]))
        values = np.concatenate((values, theta[:done]))
        space, image, residual, theta = space[:, done:], image[:, done:], residual[:, done:], theta[done:]
        if len(values) >= count and not (theta > values.min()).any():
            break
        wanted = max(1, count - len(values))
        if space.shape[1] + wanted > most:
            space, image, theta, residual = (m[..., : max(wanted, most // 2)] for m in (space, image, theta, residual))
        ritz, target = np.hstack((locked, space[:, :wanted])), theta[:wanted]
        project = lambda m, basis=ritz: m - basis @ (basis.T @ m)
        shifted = lambda m, p=project, t=target: p(product(p(m)) - p(m) * t)
        correction = _minres(shifted, project(-residual[:, :wanted]), inner_steps, 1e-3)
        new = _orthonormal(correction, np.hstack((locked, space)))
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((dimension, 1)), np.hstack((locked, space)))
        space, image = np.hstack((space, new)), np.hstack((image, product(new)))
    else:
        raise RuntimeError("the eigenpairs did not converge")
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], locked[:, order]


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole numbers of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(entries * STEPS).astype(np.int64) + SHIFT


def _pieces(batch: pa.RecordBatch, dimension: int) -> Iterator[np.ndarray]:
    for row in batch.column(0):
        yield np.frombuffer(row.as_buffer(), "<i8").reshape(-1, dimension)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform; ``basis`` has a component per column."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float

    def scaled(self) -> np.ndarray:
        return self.basis / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums).astype(np.float64) / n


def summed(blocks: DataFrame, dimension: int, kind: str, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the matrices ``of`` gives: a row per task and matrix row, added by Spark."""
    names = [f"c{k}" for k in range(shape[1])]
    dtype = np.int64 if kind == "long" else np.float64

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            for x in _pieces(batch, dimension):
                total += of(x)
        columns = [pa.array(np.arange(shape[0])), *(pa.array(total[:, k].copy()) for k in range(shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *names])

    parts = blocks.mapInArrow(run, ", ".join(["row long", *(f"{c} {kind}" for c in names)]))
    rows = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).collect()
    out = np.zeros(shape, dtype)
    for row in rows:
        out[row[0]] = row[1:]
    return out


def fit(vectors: DataFrame, vector_col: str, dimension: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows, whose vectors have ``dimension`` entries each."""
    rows_of_block = max(1, BLOCK_BYTES // (8 * dimension))

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            data = [x[k : k + rows_of_block].astype("<i8").tobytes() for k in range(0, len(x), rows_of_block)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["data"])

    entries = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = written(entries.mapInArrow(packed, "data binary"), "whitening-blocks")
    first = summed(blocks, dimension, "long", (dimension + 1, 1), lambda x: np.append(x.sum(0), len(x))[:, None])[:, 0]
    sums, n = first[:-1], int(first[-1])

    def mean_of(shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return summed(blocks, dimension, "double", shape, lambda x: of(_centred(x, n, sums))) / n

    def product(directions: np.ndarray) -> np.ndarray:
        return mean_of(directions.shape, lambda y: y.T @ (y @ directions))

    trace = float(mean_of((1, 1), lambda y: np.array([[(y * y).sum()]]))[0, 0])
    values, basis = jacobi_davidson(product, dimension, components) if trace > 0 else (np.zeros(0), np.zeros((dimension, 0)))
    some = values > NO_VARIANCE * trace
    values, basis = values[some], basis[:, some]
    error = 0.0
    if len(values):
        # One sign for all rows: the entry of largest size is positive.
        basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(len(values))])
        scaled, k = basis / np.sqrt(values), len(values)
        centre = mean_of((1, k), lambda y: (y @ scaled).sum(0)[None])
        spread = mean_of((k, k), lambda y: (z := y @ scaled - centre).T @ z)
        error = float(np.abs(spread - np.eye(k)).max())
    return Whitening(n, sums, values, basis, trace, error)


def common_dimension(vectors: DataFrame, vector_col: str) -> int | None:
    """The most frequent number of entries; a row per number is aggregated, one reaches the driver."""
    entries = F.col(vector_col).cast("array<double>")
    sizes = vectors.groupBy(F.size(entries).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform(entries, F.abs))).alias("largest")
    )
    most = sizes.where("size > 0").agg(F.max(F.struct("n", "size", "largest")).alias("most")).first().most
    if most is not None and most["n"] * (most["largest"] * STEPS + SHIFT + 1) >= 2.0**62:
        raise OverflowError("the vectors' sums exceed 64 bits")
    return None if most is None else int(most["size"])


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows with usable vectors, and ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``whitened`` and ``explained`` have an entry per component, by falling eigenvalue.
    """
    kept = [c for c in df.columns if c.lower() not in _NEW or c == vector_col]
    extra = T.StructType.fromDDL("n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    schema = T.StructType([df.schema[c] for c in kept] + extra.fields)
    vectors = df.select(*kept).where(usable(F.col(vector_col)))
    dimension = common_dimension(vectors, vector_col)
    if dimension is None:
        return df.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(F.size(vector_col) == dimension)
    model = fit(vectors, vector_col, dimension, components)
    n, sums, scaled, k = model.n, model.sums, model.scaled(), len(model.values)
    explained = model.values / model.trace if k else model.values

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            x = _matrix(batch.column(len(kept)))
            whole = n * x - sums
            if (whole.astype(np.float64) ** 2).sum(1).max(initial=0.0) >= 2.0**63:
                raise OverflowError("a deviation exceeds 64 bits")
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * k, pa.int32()), pa.array(m.ravel()))
            columns = [
                *batch.columns[: len(kept)],
                pa.array(np.full(rows, n, np.int64)),
                pa.array((whole * whole).sum(1)),
                lists((whole.astype(np.float64) / n) @ scaled),
                lists(np.tile(explained, (rows, 1))),
                pa.array(np.full(rows, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    entries = F.col(vector_col).cast("array<double>").alias("entries of the vector")
    return vectors.select("*", entries).mapInArrow(run, schema)
