"""Fits a linear model whose weights, gradients and corrections stay in blocks of ids among the tasks.

L-BFGS in the form of Chen, Wang and Zhou (2014): the direction is a combination of the corrections and the gradient, and its
coefficients follow from their dot products alone. Those, and the loss at a few step lengths, are all that reaches the driver,
so what it gets depends on the number of blocks and steps, not on how many weights there are.

Rows lie in blocks with the ids that they hold renumbered. Twice a step, blocks of rows and blocks of ids exchange one number
for each id that a block of rows holds; an id that all rows have is one number for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import Workspace, shared_dir

BIAS = -1  # the id of the free bias; ids of features aren't negative
_ENTRIES_PER_BLOCK = 500_000
_IDS_PER_BLOCK = 200_000
_CORRECTIONS = 10
_STORED_EVERY = 5  # steps; between them, lost blocks of ids are computed again
_STEPS = 2.0 ** np.arange(-10, 11)
_SEARCHES = 6
_PACKED = "labels binary, sizes binary, ids binary, vals binary"


class Rows(NamedTuple):
    """One block of rows. ``at``: places of the entries' ids; those of the i-th block of ids are ``bounds[i]`` to ``bounds[i + 1]``."""

    sides: np.ndarray
    row: np.ndarray
    at: np.ndarray
    vals: np.ndarray
    bounds: np.ndarray

    def gathered(self, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        found = np.zeros((len(parts[0][1]) if parts else 0, self.bounds[-1]))
        for block, values in parts:
            found[:, self.bounds[block] : self.bounds[block + 1]] = values
        return found

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at] * self.vals, len(self.sides))

    def times_transposed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.row] * self.vals, self.bounds[-1])


class Weights(NamedTuple):
    """One block of ids. Weights are ``scale`` times ``w``; ``places``: where the ids of each block of rows are."""

    ids: np.ndarray
    places: dict[int, np.ndarray]
    scale: np.ndarray
    penalty: np.ndarray
    w: np.ndarray
    gradient: np.ndarray
    steps: tuple[np.ndarray, ...]
    changes: tuple[np.ndarray, ...]

    def direction(self, mix: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.w))
        for c, v in zip(mix, (*self.steps, *self.changes, self.gradient)):
            out += c * v
        return out

    def products(self) -> np.ndarray:
        """Dot products among corrections, gradient and weights, plain and weighted by the penalty."""
        all_ = np.array((*self.steps, *self.changes, self.gradient, self.w))
        return np.array((all_ @ all_.T, (all_ * self.penalty) @ all_.T))


def _hinge(sides: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = 1.0 - sides * margins
    return np.maximum(short, 0.0), np.where(short > 0, -sides, 0.0)


def _logistic(sides: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    loss = np.logaddexp(0.0, -sides * margins)
    return loss, sides * np.expm1(-loss)


LOSSES = {"hinge": _hinge, "logistic": _logistic}


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids, vals = b.column("ids"), b.column("vals")
        arrays = (
            b.column("label").to_numpy(zero_copy_only=False).astype(float),
            np.diff(ids.offsets.to_numpy()).astype(np.int64),
            ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            vals.flatten().to_numpy(zero_copy_only=False).astype(float),
        )
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["labels", "sizes", "ids", "vals"])


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Spread ids over blocks, whatever their pattern."""
    mixed = ids.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(blocks)).astype(np.int64)


def _made_block(packed: Iterable, blocks: int, bias: bool) -> tuple[Rows, np.ndarray]:
    """A block of rows, and its ids by place."""
    found = [(np.frombuffer(r.labels, float), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.vals, float)) for r in packed]
    kinds = (float, np.int64, np.int64, float)
    labels, sizes, ids, vals = (np.concatenate([np.empty(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds))
    row = np.repeat(np.arange(len(labels)), sizes)
    if bias:
        row = np.concatenate((row, np.arange(len(labels))))
        ids = np.concatenate((ids, np.full(len(labels), BIAS)))
        vals = np.concatenate((vals, np.ones(len(labels))))
    own, at = np.unique(ids, return_inverse=True)
    block = _block_of(own, blocks)
    order = np.argsort(block, kind="stable")
    place = np.empty(len(own), np.int32)
    place[order] = np.arange(len(own), dtype=np.int32)
    bounds = np.searchsorted(block[order], np.arange(blocks + 1))
    return Rows(2 * labels - 1, row.astype(np.int32), place[at], vals, bounds), own[order]


def _described(part: int, block: Rows, ids: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """To each block of ids: which of them a block of rows holds, how often, and their least, greatest and squared values."""
    n = len(ids)
    least, most = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(least, block.at, block.vals)
    np.maximum.at(most, block.at, block.vals)
    facts = np.array((np.bincount(block.at, minlength=n), least, most, np.bincount(block.at, block.vals**2, n)))
    for i, (a, b) in enumerate(zip(block.bounds, block.bounds[1:])):
        if a < b:
            yield i, (part, ids[a:b], facts[:, a:b])


def _first_weights(found: list[tuple], n_rows: int, reg: float) -> Weights:
    """Weights of 0. Ids that have one value in all rows keep it, as in Spark's learners; for others the scale evens out their curvature."""
    ids = np.unique(np.concatenate([np.empty(0, np.int64), *(own for _, own, _ in found)]))
    places = {part: np.searchsorted(ids, own).astype(np.int32) for part, own, _ in found}
    count, squares = np.zeros(len(ids)), np.zeros(len(ids))
    least, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
    for part, _, facts in sorted(found, key=lambda f: f[0]):
        at = places[part]
        count[at] += facts[0]
        squares[at] += facts[3]
        least[at] = np.minimum(least[at], facts[1])
        most[at] = np.maximum(most[at], facts[2])
    one_value = (least == most) & ((count >= n_rows) | (least == 0))
    free = ids == BIAS
    penalty = np.where(free, 0.0, reg)
    curvature = squares / n_rows + penalty
    scale = np.where(one_value & ~free | (curvature <= 0), 0.0, 1.0 / np.sqrt(np.where(curvature > 0, curvature, 1.0)))
    zero = np.zeros(len(ids))
    return Weights(ids, places, scale, penalty * scale**2, zero, zero, (), ())


def _sent(block: int, x: Weights, mix: np.ndarray) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
    """To each block of rows: weights and direction of the ids that it holds."""
    both = np.array((x.w, x.direction(mix))) * x.scale
    for part, at in x.places.items():
        yield part, (block, both[:, at])


def _margins(block: Rows, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = block.gathered(parts)
    if not len(both):
        both = np.zeros((2, 0))
    return block.sides, block.times(both[0]), block.times(both[1])


def _losses(sides: np.ndarray, margins: np.ndarray, along: np.ndarray, lengths: np.ndarray, loss: str) -> np.ndarray:
    """Sums of the loss and of its slope for each length of the step."""
    out = np.zeros((2, len(lengths)))
    for i, t in enumerate(lengths):
        value, slope = LOSSES[loss](sides, margins + t * along)
        out[:, i] = value.sum(), (slope * along).sum()
    return out


def _answered(part: int, block: Rows, sides: np.ndarray, margins: np.ndarray, along: np.ndarray, length: float, loss: str):
    """To each block of ids: the sums of the loss's gradient after the step."""
    sums = block.times_transposed(LOSSES[loss](sides, margins + length * along)[1])
    for i, (a, b) in enumerate(zip(block.bounds, block.bounds[1:])):
        if a < b:
            yield i, (part, sums[a:b])


def _stepped(x: Weights, parts: list, mix: np.ndarray, length: float, n_rows: int, first: bool) -> Weights:
    gradient = np.zeros(len(x.w))
    for part, sums in sorted(parts, key=lambda p: p[0]):
        gradient[x.places[part]] += sums
    step = length * x.direction(mix)
    w = x.w + step
    gradient = gradient / n_rows * x.scale + x.penalty * w
    if first:
        return x._replace(w=w, gradient=gradient)
    steps, changes = (*x.steps, step), (*x.changes, gradient - x.gradient)
    return x._replace(w=w, gradient=gradient, steps=steps[-_CORRECTIONS:], changes=changes[-_CORRECTIONS:])


def _mix(products: np.ndarray, steepest: bool) -> np.ndarray:
    """Coefficients of corrections and gradient in the direction: the two loops of L-BFGS on dot products."""
    k = (len(products) - 2) // 2
    out = np.zeros(2 * k + 1)
    out[2 * k] = -1.0
    dots = products[: 2 * k + 1, : 2 * k + 1]
    used = [] if steepest else [i for i in range(k) if dots[i, k + i] > 1e-12 * dots[k + i, k + i]]
    alphas = {}
    for i in reversed(used):
        alphas[i] = out @ dots[:, i] / dots[i, k + i]
        out[k + i] -= alphas[i]
    if used:
        out *= dots[used[-1], k + used[-1]] / dots[k + used[-1], k + used[-1]]
    for i in used:
        out[i] += alphas[i] - out @ dots[:, k + i] / dots[i, k + i]
    return out


def _length(risk: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], value: float, slope: float) -> tuple[float, float]:
    """The risk after a step with enough descent and a flat enough slope, or at least a descent, and its length; 0 if there is none.

    The risk is convex along the step, so lengths that are too short and too long close in on those that will do.
    """
    low, high, lengths, best = 0.0, np.inf, _STEPS, (value, 0.0)
    for _ in range(_SEARCHES):
        values, slopes = risk(lengths)
        best = min(best, *zip(values.tolist(), lengths.tolist()))
        long = ~((values <= value + 1e-4 * lengths * slope) & (values < value))
        short = ~long & (slopes < 0.9 * slope)
        if not (long | short).all():
            return min(zip(values[~(long | short)].tolist(), lengths[~(long | short)].tolist()))
        low, high = max([low, *lengths[short]]), min([high, *lengths[long]])
        if high == np.inf:
            lengths = low * _STEPS / _STEPS[0] * 2
        elif low == 0:
            lengths = high * _STEPS / _STEPS[-1] / 2
        else:
            lengths = np.linspace(low, high, len(_STEPS) + 2)[1:-1]
    return best


@dataclass
class SpreadFit:
    """Mean loss plus ``reg`` / 2 times the squared weights; stops as Spark's learners do, at ``max_iter`` steps or by ``tol``."""

    loss: str
    max_iter: int
    reg: float
    tol: float
    free_bias: bool

    def fit(self, rows: DataFrame, n_rows: int, n_entries: int, n_ids: int) -> tuple[DataFrame, float]:
        """Table of sig_id and weight, without zeros, and the bias. ``rows``: a stored table of label, ids and vals."""
        spark = rows.sparkSession
        shared_dir(spark)
        self._work, self._n = Workspace(spark, "fit"), n_rows
        self._blocks = max(1, -(-n_ids // _IDS_PER_BLOCK))
        self._rows, state = self._start(rows, max(1, -(-n_entries // _ENTRIES_PER_BLOCK)))
        # As dealt: blocks are met by partition, whatever number was asked for.
        self._parts, self._blocks = self._rows.getNumPartitions(), state.getNumPartitions()
        kept = [self._rows]
        try:
            state = self._minimised(state, kept)
            table = spark.createDataFrame(state.flatMap(lambda x: zip(x.ids.tolist(), (x.w * x.scale).tolist())), "sig_id bigint, weight double")
            stored = self._work.write(table.filter(F.col("weight") != 0), "weights")
            bias = stored.filter(F.col("sig_id") == BIAS).collect() if self.free_bias else []
            return stored.filter(F.col("sig_id") != BIAS), float(bias[0].weight) if bias else 0.0
        finally:
            for rdd in kept:
                self._drop(rdd)

    def _drop(self, rdd: RDD) -> None:
        rdd.unpersist()
        path = rdd.getCheckpointFile()
        if path:
            Workspace(self._work.spark, root=path.rsplit("/", 1)[0]).remove(path.rsplit("/", 1)[1])

    def _start(self, rows: DataFrame, parts: int) -> tuple[RDD, RDD]:
        n, reg, blocks, bias = self._n, self.reg, self._blocks, self.free_bias
        packed = rows.select("label", "ids", "vals").repartition(parts).mapInArrow(_pack, _PACKED)
        # Dealt in the way that what blocks of ids send is dealt, so that the two meet.
        dealt = packed.rdd.mapPartitionsWithIndex(lambda part, found: ((part, r) for r in found)).partitionBy(parts, int)
        made = dealt.mapPartitions(lambda found: [_made_block((r for _, r in found), blocks, bias)]).persist(StorageLevel.MEMORY_AND_DISK)
        made.checkpoint()
        made.count()
        facts = made.mapPartitionsWithIndex(lambda part, found: (m for x in found for m in _described(part, *x)))
        state = facts.partitionBy(blocks, int).mapPartitions(lambda found: [_first_weights([m for _, m in found], n, reg)])
        return made, state

    def _along(self, state: RDD, mix: np.ndarray) -> RDD:
        sent = state.mapPartitionsWithIndex(lambda block, found: (m for x in found for m in _sent(block, x, mix)))
        parts = sent.partitionBy(self._parts, int).mapPartitions(lambda found: [[m for _, m in found]])
        return self._rows.zip(parts).map(lambda x: _margins(x[0][0], x[1])).persist(StorageLevel.MEMORY_AND_DISK)

    def _risks(self, margins: RDD, lengths: np.ndarray) -> np.ndarray:
        loss = self.loss
        return margins.map(lambda x: _losses(*x, lengths, loss)).treeReduce(lambda a, b: a + b) / self._n

    def _next(self, state: RDD, margins: RDD, mix: np.ndarray, length: float, stored: bool, first: bool = False) -> tuple[RDD, np.ndarray]:
        n, loss = self._n, self.loss
        answers = self._rows.zip(margins).mapPartitionsWithIndex(
            lambda part, found: (m for x, along in found for m in _answered(part, x[0], *along, length, loss))
        )
        parts = answers.partitionBy(self._blocks, int).mapPartitions(lambda found: [[m for _, m in found]])
        after = state.zip(parts).map(lambda x: _stepped(x[0], x[1], mix, length, n, first)).persist(StorageLevel.MEMORY_AND_DISK)
        if stored:
            after.checkpoint()
        return after, after.map(lambda x: x.products()).treeReduce(lambda a, b: a + b)

    def _minimised(self, state: RDD, kept: list[RDD]) -> RDD:
        """``kept``: what is to be dropped in the end."""
        none = np.zeros(1)
        margins = self._along(state, none)
        values = [float(self._risks(margins, none)[0, 0])]
        state, (dots, weighted) = self._next(state, margins, none, 0.0, stored=True, first=True)
        kept.append(state)
        margins.unpersist()
        step, steepest = 0, False
        while step < self.max_iter and np.sqrt(dots[-2, -2]) > max(self.tol * abs(values[-1]), 1e-8):
            mix = _mix(dots, steepest)
            slope = mix @ dots[:-1, -2]
            around = (weighted[-1, -1], mix @ weighted[:-1, -1], mix @ weighted[:-1, :-1] @ mix)
            margins = self._along(state, mix)

            def risk(lengths: np.ndarray) -> np.ndarray:
                sums, slopes = self._risks(margins, lengths)
                return sums + (around[0] + 2 * lengths * around[1] + lengths**2 * around[2]) / 2, slopes + around[1] + lengths * around[2]

            value, length = _length(risk, values[-1], slope) if slope < 0 else (values[-1], 0.0)
            if length == 0:
                margins.unpersist()
                if steepest or len(dots) == 2:
                    break
                steepest = True
                continue
            values.append(value)
            step, steepest = step + 1, False
            state, (dots, weighted) = self._next(state, margins, mix, length, stored=step % _STORED_EVERY == 0)
            margins.unpersist()
            kept.append(state)
            # The newest stored blocks and those after them are enough to go on.
            newest = max(i for i, rdd in enumerate(kept) if rdd.isCheckpointed())
            for rdd in kept[1:newest]:
                self._drop(rdd)
            del kept[1:newest]
            for rdd in kept[newest:-1]:
                rdd.unpersist()
            if abs(max(values[-11:-1]) - values[-1]) <= self.tol * abs(values[0]):
                break
        return state
