"""What tasks do with Arrow batches of predictions.

Workers import this module by name, so it needs no more than numpy and Arrow. The functions take and return one batch: Spark
evaluates one upon another in the same worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def margins(features: pa.StructArray, ids: np.ndarray, weights: np.ndarray, intercept: float) -> pa.Array:
    """w.x + b of a batch of sparse vectors; ``ids`` ascend. Null for a null vector."""
    wanted, vals = features.field("ids"), features.field("vals")
    empty = pa.scalar([], wanted.type), pa.scalar([], vals.type)
    null = np.asarray(features.is_null()) | np.asarray(wanted.is_null()) | np.asarray(vals.is_null())
    wanted, vals = wanted.fill_null(empty[0]), vals.fill_null(empty[1])
    lengths = np.diff(wanted.offsets.to_numpy())
    found = np.zeros(int(lengths.sum()))
    if len(ids) and len(found):
        keys = wanted.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
        found = np.where(ids[at] == keys, weights[at], 0.0) * vals.flatten().to_numpy(zero_copy_only=False)
    sums = np.zeros(len(lengths))
    # Sums in order of the ids, each row by itself, so that equal vectors have equal margins.
    held = np.flatnonzero(lengths)
    if len(held):
        sums[held] = np.add.reduceat(found, (np.cumsum(lengths) - lengths)[held])
    return pa.array(sums + intercept, pa.float64(), mask=null)


def p_values(margin: pa.Array, strangeness: dict[int, np.ndarray]) -> pa.StructArray:
    """p0 and p1 of a batch of margins, by binary search in the sorted strangeness of each class; null for a null or NaN margin."""
    m = margin.to_numpy(zero_copy_only=False).astype(float)
    out = []
    for c in (0, 1):
        at_least = len(strangeness[c]) - np.searchsorted(strangeness[c], -m if c == 1 else m, side="left")
        out.append(pa.array((at_least + 1.0) / (len(strangeness[c]) + 1.0), pa.float64(), mask=np.isnan(m)))
    return pa.StructArray.from_arrays(out, ["p0", "p1"])
