"""Tables of vectors: which rows count, how wide they are, and their integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 1024 times a component has to be below this.
LARGEST = 1 << 52


def finite(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is not null and has finite components only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.where(F.col(column).isNotNull() & F.forall(F.col(column).cast("array<double>"), fine))


def width(df: DataFrame, column: str) -> int | None:
    """The length that all vectors have, None without vectors; different lengths are an error."""
    least, most = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} components in one table")
    return least


def integers(column: pa.Array, n: int, add: int = 0) -> np.ndarray:
    """A row for each vector: floor(1024 * x) + add of its n components."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n) * 1024.0)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ArithmeticError(f"a component is {LARGEST // 1024} or more in size")
    return x.astype(np.int64) + add
