"""Isolation forest: trees grown in parallel on small samples, scored by broadcast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES = 200
SAMPLE = 256


def _path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes as (feature, cut, left, right, path length at a leaf)."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = (-1, 0.0, -1, -1, depth + _path_constant(len(rows)))
            return at
        feature = int(rng.choice(usable))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = float(rng.uniform(low, high))
        left = rows[:, feature] <= cut
        nodes[at] = (feature, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1), 0.0)
        return at

    build(points, 0)
    return nodes


class IsolationForest:
    """Fitted trees; at most TREES * (2 * SAMPLE - 1) nodes, so safe to broadcast."""

    def __init__(self, trees: list[list[tuple]], sample: int):
        self.trees = trees
        self.sample = sample

    def score(self, df: DataFrame, features: str = "features", name: str = "score") -> DataFrame:
        """Add the anomaly score 2 ** (-mean path / expected path), in (0, 1)."""
        shared = df.sparkSession.sparkContext.broadcast([
            tuple(np.array(c) for c in zip(*tree)) for tree in self.trees])
        expected = _path_constant(self.sample)

        @F.pandas_udf("double")
        def run(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy())
            total = np.zeros(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = np.flatnonzero(feature[at] >= 0)
                    if not len(inner):
                        break
                    node = at[inner]
                    goes_left = x[inner, feature[node]] <= cut[node]
                    at[inner] = np.where(goes_left, left[node], right[node])
                total += path[at]
            return pd.Series(np.exp2(-total / len(shared.value) / expected))

        return df.withColumn(name, run(vector_to_array(F.col(features))))


def fit_isolation(df: DataFrame, id_col: str, features: str = "features", trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> IsolationForest:
    """Grow each tree on about ``sample`` rows drawn for it.

    A row joins a tree by a seeded hash, so about trees * sample rows leave the
    scan in all, however long the table is.
    """
    n = df.count()
    each = min(1.0, sample / max(n, 1))
    pool = min(1.0, 4.0 * trees * each)
    share = each / pool
    spread = F.lit(float(2**62))
    picked = df.where((F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**62))) / spread < pool).select(
        vector_to_array(F.col(features)).alias("x"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: (
            F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), t), F.lit(2**62))) / spread < share)).alias("tree"))
    limit = max(1, math.ceil(math.log2(max(2, min(sample, n)))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.stack(pdf.sort_values("x", key=lambda s: s.map(tuple))["x"].to_numpy())
        nodes = _grow(points, limit, np.random.default_rng(seed * 1000003 + tree))
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)],
                            columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    rows = picked.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, path double").collect()
    grown: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        grown.setdefault(r["tree"], []).append((r["feature"], r["cut"], r["left"], r["right"], r["path"]))
    return IsolationForest([grown[t] for t in sorted(grown)], min(sample, n))


def flag_share(df: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Flag the given share of rows with the highest scores."""
    cut = df.agg(F.percentile_approx(score, 1.0 - share, 100000).alias("c")).first()["c"]
    return df.withColumn("is_anomaly_pred", (F.col(score) > F.lit(float(cut if cut is not None else 1.0))).cast("int"))
