"""Vectors as exact integers, for operators whose scores must not round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1 << 26  # of a component, so that sums of squares over 1,024 components stay below 2^63


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def floors(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of all components, one after another, and the vectors' edges among them."""
    edges = vectors.offsets.to_numpy().astype(np.int64)
    x = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64))[edges[0] : edges[-1]] if len(vectors) else np.empty(0)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} in size: products of such vectors do not fit 64 bits")
    return x.astype(np.int64), edges - (edges[0] if len(edges) else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in exact int64; by way of doubles where no sum can leave their 53 bits."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products do not fit 64 bits")
    return a @ b.T


def narrow(x: np.ndarray) -> np.ndarray:
    """The same in the smallest integer type that holds it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
