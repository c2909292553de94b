"""Vectors of many rows as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def of_one_length(vectors: DataFrame, column: str, length: int | None) -> tuple[DataFrame, int, str]:
    """(vec_id, vec) of the rows whose vector has ``length`` entries, that length, and the NumPy type of the entries.

    Without a ``length`` it is the one most rows have, the longer of two as frequent; 0 if no row has an entry.
    """
    kind = vectors.schema[column].dataType.elementType
    single = isinstance(kind, T.FloatType)
    vec = F.col(column) if single or isinstance(kind, T.DoubleType) else F.col(column).cast("array<double>")
    named = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).where("vec IS NOT NULL AND size(vec) > 0")
    if length is None:
        most = named.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        length = most["size"] if most else 0
    return named.where(F.size("vec") == length), length, "<f4" if single else "<f8"


def matrix(column: pa.Array, length: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column whose lists all have ``length`` entries, and which of them are finite throughout."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # a null entry becomes NaN
    rows = flat.reshape(len(column), length)
    return rows, np.isfinite(rows).all(axis=1)


def unpacked(column: pa.Array, length: int, kind: str) -> np.ndarray:
    """Rows packed as bytes, in double precision."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(-1, length).astype(np.float64)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, added from the first entry to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total
