"""Linear support vectors with the squared hinge loss.

Spark's own linear SVM has the plain hinge. The loss is smooth here, so a limited-memory
quasi-Newton method finds the optimum: each step is one pass in which tasks sum loss
and gradient over their rows; the driver holds the weights and a few of their differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.operators.ml.vectors import Rows, parts, scored

MEMORY = 10


class LinearModel:
    """Weights and intercept; scores are margins."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, float(intercept)

    def add_score(self, df: DataFrame, name: str) -> DataFrame:
        weights, intercept = self.weights, self.intercept
        return scored(df, name, lambda rows: rows.dot(weights) + intercept)

    def write(self) -> LinearModel:
        return self

    def save(self, path: str) -> None:
        rows = [(self.intercept, self.weights.tolist())]
        SparkSession.getActiveSession().createDataFrame(rows, "intercept double, weights array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(path: str) -> LinearModel:
        row = SparkSession.getActiveSession().read.parquet(path).first()
        return LinearModel(np.array(row["weights"]), row["intercept"])


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Two-loop quasi-Newton steps, halved until the loss falls enough; ends once the gradient has shrunk by ``tolerance``."""
    x, steps = start, []
    value, grad = loss(x)
    first = np.linalg.norm(grad)
    for _ in range(rounds):
        if np.linalg.norm(grad) <= tolerance * max(first, 1e-300):
            break
        way, shares = -grad, []
        for s, y in reversed(steps):
            shares.append(s @ way / (s @ y))
            way = way - shares[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), share in zip(steps, reversed(shares)):
            way = way + (share - y @ way / (s @ y)) * s
        size = 1.0 if steps else 1.0 / max(first, 1e-300)
        while True:
            new = x + size * way
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * size * (grad @ way) or size < 1e-10:
                break
            size /= 2
        if new_value >= value:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
        x, value, grad = new, new_value, new_grad
    return x


def fit_squared_hinge(rows: DataFrame, width: int, strength: float = 1.0, rounds: int = 100, tolerance: float = 1e-5) -> LinearModel:
    """Minimise (|w|^2 + b^2) / 2 + strength * sum of weight * max(0, 1 - y (w x + b))^2 over (label, weight, features).

    ``rows`` should be kept or written: every pass reads them.
    """
    plain = rows.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), *parts())
    groups = max(1, int(plain.rdd.getNumPartitions() ** 0.5))

    def summed(size: int, of: Callable[[Rows, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += of(Rows.of_arrow(batch), 2 * batch.column("label").to_numpy() - 1, batch.column("weight").to_numpy())
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for sums in batch.column("sums"):
                    total += np.frombuffer(sums.as_py())
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
        made = plain.mapInArrow(run, "sums binary")
        if groups > 4:  # partial sums meet in a few tasks first
            made = made.repartition(groups).mapInArrow(add, "sums binary")
        return sum((np.frombuffer(r["sums"]) for r in made.collect()), np.zeros(size))

    def squares(part: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(part.index, weight[part.row] * part.value**2, width), weight.sum())
    # steps are taken in units that give every weight about the same curvature
    unit = 1 / np.sqrt(1 + 2 * strength * summed(width + 1, squares))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        x = v * unit

        def slopes(part: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
            short = np.maximum(1 - y * (part.dot(x[:-1]) + x[-1]), 0)
            slope = -2 * weight * y * short
            return np.concatenate([np.bincount(part.index, slope[part.row] * part.value, width), [slope.sum(), (weight * short**2).sum()]])
        total = summed(width + 2, slopes)
        return float(x @ x / 2 + strength * total[-1]), (x + strength * total[:-1]) * unit

    x = unit * minimise(loss, np.zeros(width + 1), rounds, tolerance)
    return LinearModel(x[:-1], x[-1])
