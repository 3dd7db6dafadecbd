"""What the vector operators share: whole-number components of float vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this are cut to it, so that squares of differences and their sums fit a long.
MOST = 2**27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are, as finite numbers."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), real), F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as an array of int; products with a power of two are exact."""
    cut = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return F.transform(vector.cast("array<double>"), cut)


def kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows of ``df`` whose vector is finite."""
    return df.where(finite(df[vector]))


def matrix(column: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column, all of ``dim`` components, as a matrix of int64."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dim)
