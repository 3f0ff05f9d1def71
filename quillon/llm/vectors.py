"""Vectors as exact integers, for the operators that score and cluster them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond this are set to it, so that no score or distance leaves 64 bits at up to 2,048 components.
LARGEST = 1 << 24


def finite(embedding: str) -> Column:
    """The vector is there and no component is null, NaN or infinite."""
    bound = F.lit(1.7976931348623157e308)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= bound)
    return F.coalesce(F.col(embedding).isNotNull() & F.forall(embedding, good), F.lit(False))


def scaled(embedding: str) -> Column:
    """floor(256 * x) of each component, x as double; beyond ``LARGEST`` cut to it."""

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(256.0 * x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
        return F.floor(y).cast("int")

    return F.transform(embedding, whole)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of 64-bit integers; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), width or 0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: by floating point where no sum can reach 2^53, else by whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
