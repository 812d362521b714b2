"""Vectors as integers, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(vector: F.Column) -> F.Column:
    """Whether a vector is not null, not empty, and holds finite values only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def scaled(vector: F.Column, scale: int, bound: int) -> F.Column:
    """floor(scale * value) of each value as a double, held within +-``bound``."""
    hold = lambda v: F.greatest(F.least(v, F.lit(float(bound))), F.lit(-float(bound)))
    return F.transform(vector, lambda c: F.floor(hold(c.cast("double") * scale)).cast("long"))


def usual_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, the smallest of several; 0 without vectors."""
    first = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A row for each vector of the column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
