"""What the operators on ``embeddings`` share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~bad & some, F.lit(False))


def packed(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors in double precision, with their number of components."""
    return df.withColumn(vector, F.col(vector).cast("array<double>")).withColumn("dim", F.size(vector))


def sized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors with their number of components: single precision stays, all else becomes double."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    return df.withColumn(vector, F.col(vector) if single else F.col(vector).cast("array<double>")).withColumn("dim", F.size(vector))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` entries, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
