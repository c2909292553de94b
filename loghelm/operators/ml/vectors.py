"""Feature vectors as index and value lists, and models that score them without a dense copy of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(features: str = "features") -> list[Column]:
    """Indices (null for a dense vector) and values of a vector column."""
    raw = F.unwrap_udt(F.col(features))
    return [raw["indices"].alias("indices"), raw["values"].alias("values")]


class Rows:
    """Sparse rows: row ``i`` holds entries ``start[i]`` to ``start[i + 1] - 1`` of ``index`` and ``value``."""

    def __init__(self, start: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.start, self.index, self.value = start, index, value
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def __len__(self) -> int:
        return len(self.start) - 1

    @staticmethod
    def of(indices: list, values: list) -> Rows:
        value = [np.asarray(v, np.float64) for v in values]
        index = [np.arange(len(v), dtype=np.int64) if i is None else np.asarray(i, np.int64) for i, v in zip(indices, value)]
        start = np.concatenate([[0], np.cumsum([len(v) for v in value], dtype=np.int64)])
        none_i, none_v = np.zeros(0, np.int64), np.zeros(0)
        return Rows(start, np.concatenate([none_i, *index]), np.concatenate([none_v, *value]))

    @staticmethod
    def of_arrow(batch: pa.RecordBatch | pa.Table) -> Rows:
        return Rows.of_lists(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("indices"), batch.column("values"))))

    @staticmethod
    def of_lists(indices: pa.ListArray, values: pa.ListArray) -> Rows:
        if indices.null_count:  # dense vectors
            return Rows.of(indices.to_pandas().tolist(), values.to_pandas().tolist())
        sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), indices.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, len(self))

    def dense(self, begin: int, end: int, width: int) -> np.ndarray:
        out = np.zeros((end - begin, width))
        at = slice(self.start[begin], self.start[end])
        out[self.row[at] - begin, self.index[at]] = self.value[at]
        return out


def scored(df: DataFrame, name: str, score, features: str = "features") -> DataFrame:
    """Add what ``score`` makes of the rows' vectors, batch by batch."""

    @F.arrow_udf("double")
    def run(indices: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array(score(Rows.of_lists(indices, values)), pa.float64())

    return df.withColumn(name, run(*parts(features)))
