"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never multiplied with themselves. From a unit vector v, the products X v, over all rows, and Xᵀ u, summed
over all rows, are taken in turn, which makes orthonormal u and v with U B = X V for a small bidiagonal matrix B. The singular
values of B are those of X, and its right vectors, carried back by V, are the components.

The long vectors u are not stored: each is X w for a short w that the driver keeps, so both products of a step are one pass over
the rows, in which a task reads its blocks and returns one vector of sums. New vectors of either kind are orthogonalised
against all earlier ones; with Xᵀ u kept for every u this needs no further pass. Where the Krylov space ends, as for
eigenvalues that occur several times, a new start orthogonal to all so far goes on. The steps go on to the full dimension, so no
component depends on a test of convergence: as many passes as dimensions, each linear in the rows.

Entries are whole numbers, floor(scale * entry) + offset, so counts, means and deviations are exact. Rows are packed into blocks
once, and every pass starts at those files.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_batches
from gleaner.llm.sums import few_tasks, for_passes, summed
from gleaner.session import Workspace

#: Entries that a block holds, about.
BLOCK = 1 << 16
#: Blocks that go to Python at once.
BATCH_BLOCKS = 16
#: A deviation above this is not a long; the result is null.
LARGEST = (1 << 63) - 1


class Whitening(NamedTuple):
    """A fit: rows, exact sums by dimension, unit components as columns, their variances, all variances together."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fixed_point(vector: Column, scale: int) -> Column:
    """floor(scale * entry) for each entry; null unless all entries are finite numbers."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(entries, lambda c: F.floor(c * scale)))


def _pack_task(d: int):
    per = max(1, BLOCK // max(d, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, per):
                part = batch.slice(first, per)
                lists = part.column("x")
                lengths = np.diff(lists.offsets.to_numpy())
                x = np.zeros((part.num_rows, d), np.int64)
                x[np.arange(d) < lengths[:, None]] = lists.flatten().to_numpy()
                small = np.abs(x).max(initial=0) < 1 << 31
                sums = [sum(column) for column in x.T.tolist()] if not small else x.sum(axis=0).tolist()
                values = (x.astype(np.int32) if small else x).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                texts = pa.array([[str(s) for s in sums]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int64()), pa.array([values], pa.binary()), texts], ["ids", "n", "block", "sums"])

    return pack


class Blocks(NamedTuple):
    """A stored table of blocks, the dimension of their rows, and whether a pass over it has few tasks."""

    table: DataFrame
    d: int
    direct: bool


def pack(vectors: DataFrame, work: Workspace) -> Blocks:
    """Blocks of the rows of ``vectors`` (id, x). The dimension is the greatest length; shorter rows end in zeros."""
    d = int(vectors.agg(F.max(F.size("x"))).first()[0] or 0)
    with arrow_batches(vectors.sparkSession, max(1, 16 * BLOCK // max(d, 1))):
        blocks = vectors.mapInArrow(_pack_task(d), "ids array<bigint>, n bigint, block binary, sums array<string>")
        table = for_passes(work.write(blocks, "blocks"))
    return Blocks(table, d, few_tasks(table))


def _rows(block: memoryview, n: int, d: int) -> np.ndarray:
    size = len(block) // max(n * d, 1)
    return np.frombuffer(block, np.int32 if size == 4 else np.int64).reshape(n, d)


def _sum_pass(blocks: Blocks, width: int, add) -> np.ndarray:
    """The sum over all blocks of ``add(rows)``, an array of ``width`` numbers."""

    def add_batch(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(width)
        for n, block in zip(batch.column("n").to_pylist(), batch.column("block")):
            total += add(_rows(block.as_buffer(), n, d))
        return total

    d = blocks.d
    return summed(blocks.table.select("n", "block"), width, add_batch, BATCH_BLOCKS, blocks.direct)


def _products(mean: np.ndarray, z: np.ndarray):
    def add(rows: np.ndarray) -> np.ndarray:
        x = rows - mean
        return (x @ z) @ x

    return add


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``; twice, as rounding leaves some the first time."""
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        v = v - b.T @ (b @ v)
    return v


def bidiagonalise(product, d: int, scale: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with orthonormal columns V and bidiagonal B, so that X V = U B for some orthonormal U.

    ``product(z)`` is Xᵀ X z, taken as Xᵀ (X z). ``scale`` is the root of the sum of squares of X: what is below its rounding is 0.
    """
    rng, tiny = np.random.default_rng(seed), scale * np.finfo(float).eps * max(d, 8)
    right: list[np.ndarray] = []
    short: list[np.ndarray] = []  # w with u = X w
    back: list[np.ndarray] = []  # Xᵀ u
    b = np.zeros((d, d))
    follow, beta = None, 0.0
    for k in range(d):
        if follow is None:
            follow = _orthogonal(rng.standard_normal(d), right)
            follow, beta = follow / np.linalg.norm(follow), 0.0
        v = _orthogonal(follow, right)
        right.append(v := v / np.linalg.norm(v))
        z = v - beta * short[-1] if beta else v
        g = product(z)
        if short:
            # uᵀ X z of each earlier u, taken away from X z and from Xᵀ X z alike.
            along = np.array(short) @ g
            z, g = z - along @ np.array(short), g - along @ np.array(back)
        alpha = np.sqrt(max(float(z @ g), 0.0))
        follow = None
        if alpha > tiny:
            b[k, k] = alpha
            short.append(z / alpha)
            back.append(g / alpha)
            r = _orthogonal(back[-1], right)
            beta = float(np.linalg.norm(r))
            if beta > tiny and k + 1 < d:
                follow, b[k, k + 1] = r / beta, beta
    return np.array(right).T, b


def fit(blocks: Blocks, components: int = 32) -> Whitening:
    """The whitening of the rows in ``blocks``. Components whose variance is below the rounding of the largest are left out."""
    d = blocks.d
    each = blocks.table.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    n = int(blocks.table.agg(F.sum("n")).first()[0] or 0)
    sums = [int(r["s"]) for r in sorted(each, key=lambda r: r["at"])]
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    mean = np.array([s / n for s in sums])
    squares = float(_sum_pass(blocks, 1, lambda rows: np.array([np.square(rows - mean).sum()]))[0])
    if squares == 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    v, b = bidiagonalise(lambda z: _sum_pass(blocks, d, _products(mean, z)), d, np.sqrt(squares))
    _, values, q = np.linalg.svd(b)
    variances = values**2 / n
    kept = min(components, int(np.count_nonzero(variances > variances[0] * np.finfo(float).eps * 4 * d)))
    return Whitening(n, sums, v @ q.T[:, :kept], variances[:kept], squares / n)


def _white(model: Whitening, rows: np.ndarray) -> np.ndarray:
    return (rows - model.mean()) @ model.components / np.sqrt(model.variances)


def identity_error(blocks: Blocks, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.variances)
    if not k:
        return 0.0

    def add(rows: np.ndarray) -> np.ndarray:
        y = _white(model, rows)
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    total = _sum_pass(blocks, k * k + k, add) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(model: Whitening, rows: np.ndarray) -> list[int | None]:
    """Sums of (n * x - S)² by row, exact; null where they don't fit into a long."""
    rough = np.square((rows - model.mean()) * float(model.n)).sum(axis=1)
    if rough.max(initial=0) < float(1 << 61) and max(map(abs, model.sums), default=0) < 1 << 61 and float(np.abs(rows).max(initial=0)) * model.n < float(1 << 61):
        return np.square(rows.astype(np.int64) * model.n - np.array(model.sums, np.int64)).sum(axis=1).tolist()
    exact = [sum((model.n * x - s) ** 2 for x, s in zip(row, model.sums)) for row in rows.tolist()]
    return [e if e <= LARGEST else None for e in exact]


def _project_task(model: Whitening, d: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, block) in enumerate(zip(batch.column("n").to_pylist(), batch.column("block"))):
                rows = _rows(block.as_buffer(), n, d)
                white = _white(model, rows)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * white.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(_deviations(model, rows), pa.int64()), lists], ["id", "deviation", "whitened"])

    return project


def transform(blocks: Blocks, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) for every row in ``blocks``."""
    return blocks.table.select("ids", "n", "block").mapInArrow(_project_task(model, blocks.d), "id bigint, deviation bigint, whitened array<double>")


def whitened_rows(table: DataFrame, id_column: str, vector: str, scale: int = 64, offset: int = 0, components: int = 32) -> DataFrame:
    """A row for each row of ``table`` and component: the id, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as the whole number x = floor(scale * c) + ``offset``. Rows whose vector is null or holds a null or an entry that
    isn't finite are left out; a vector shorter than the longest ends in entries of 0. Components are numbered from 1 by falling
    variance; there are fewer than ``components`` where the covariance has a smaller rank, and none, so no rows, if all vectors are
    equal or there is none. ``deviation`` is the sum over dimensions of (n x - S)², exact, null where that isn't a long; ``explained``
    the component's share of all variance; ``identity_error`` how far the whitened covariance is from the identity. Repeated rows
    and null ids are rows like others; other columns are not read.
    """
    # The offset cancels wherever rows are centred, so it is left out of the numbers that are worked with.
    vectors = table.select(F.col(id_column).cast("bigint").alias("id"), fixed_point(F.col(vector), scale).alias("x")).where("x is not null")
    work = Workspace(table.sparkSession, "whitening")
    blocks = pack(vectors, work)
    model = fit(blocks, components)
    error = identity_error(blocks, model)
    each = transform(blocks, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(e / model.total) for e in model.variances]
    explained = F.get(F.array(*[F.lit(s) for s in shares]), F.col("at")) if shares else F.lit(None).cast("double")
    return each.select(
        F.col("id").alias(id_column),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
