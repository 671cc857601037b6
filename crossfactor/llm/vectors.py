"""Embeddings as integer vectors, for clustering and search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Integers a unit, and the largest integer for which sums of 64 squared differences stay in 64 bits.
STEPS, LARGEST = 64, 1 << 27


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(64 x) of each component; raises for |64 x| over 2**27, whose squared distances may not fit in 64 bits."""

    def one(x: Column) -> Column:
        scaled = F.lit(float(STEPS)) * x.cast("double")
        return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // STEPS}")).cast("int"))

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of 64-bit integers, shorter lists filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
