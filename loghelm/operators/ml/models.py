"""Classifiers, calibration, search, comparison and transfer."""

from __future__ import annotations

import json
import math
import random
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.scoring import keyword_score
from loghelm.operators import split
from loghelm.operators.evaluate import confusion_counts, cross_validated, metrics
from loghelm.operators.ml.forest import bin_rows, fit_forest, shared
from loghelm.operators.ml.linear import fit_squared_hinge
from loghelm.operators.ml.stages import feature_names

# Search spaces. Without a depth a tree grows until its leaves are pure.
GRID = {"numTrees": [100, 200], "maxDepth": [None, 20, 40], "minInstancesPerSplit": [2, 5], "minInstancesPerNode": [1, 2]}
RANDOM_SPACE = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
RANDOM_DRAWS = 10
SEED = 42


def logistic(rows: float, **params) -> LogisticRegression:
    """Unfitted regression with balanced weights in ``weight``.

    The penalty 1 / (C * sum of weights) with C = 1 matches a solver that sums its loss instead of averaging it.
    """
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", **{
        "maxIter": 500, "standardization": False, "regParam": 1.0 / rows, **params})


def fit(train: DataFrame, name: str, **params):
    """Fit on (features, label); class weights are balanced.

    A forest goes over the rows once. For the others the rows are kept, as their passes would otherwise redo the text
    features every time.
    """
    if name == "random_forest":
        return fit_forest(train, **{"seed": SEED, **params})
    kept = train.select("label", "features").persist()
    weighted = split.with_weights(kept, "label")
    if name == "logreg":
        model = logistic(float(kept.count()), **params).fit(weighted)
    elif name == "linear_svm":
        raw = F.unwrap_udt(F.col("features"))
        size = kept.agg(F.max(F.coalesce(raw["size"], F.size(raw["values"]))).alias("width"), F.count(F.lit(1)).alias("rows")).first()
        # a pass over few rows costs what its tasks cost to start
        parts = min(kept.rdd.getNumPartitions(), -(-size["rows"] // 5_000))
        model = fit_squared_hinge(weighted.coalesce(max(parts, 1)), int(size["width"] or 0), **params)
    else:
        raise ValueError(f"unknown model {name}")
    kept.unpersist()
    return model


def raw_score(df: DataFrame) -> Column:
    """Probability of class 1 where the model has one, else its margin."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def score(model, df: DataFrame, name: str = "score") -> DataFrame:
    if hasattr(model, "add_score"):
        return model.add_score(df, name)
    out = model.transform(df)
    return out.withColumn(name, raw_score(out)).drop("rawPrediction", "probability", "prediction")


def score_with_fallback(model, df: DataFrame, message: str = "message") -> DataFrame:
    """Model probability; the keyword score where there is no text to score."""
    out = score(model, df, "_p")
    usable = F.col(message).isNotNull() & ~F.isnan("_p")
    return out.withColumn("prob_anomaly", F.coalesce(F.when(usable, F.col("_p")), keyword_score(F.col(message)))).drop("_p")


class CalibratedModel:
    """Mean of sigmoid-calibrated base models, one per fold."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        out = df
        for i, (base, slope, shift) in enumerate(self.parts):
            out = score(base, out, f"_s{i}")
            total = total + 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col(f"_s{i}") + F.lit(shift))))
        mean = total / len(self.parts)
        return out.withColumn("score", mean).drop(*[f"_s{i}" for i in range(len(self.parts))])

    def save(self, path: str) -> None:
        for i, (base, _, _) in enumerate(self.parts):
            base.write().save(f"{path}/base={i}")
        rows = [(i, type(b).__module__, type(b).__name__, s, t) for i, (b, s, t) in enumerate(self.parts)]
        _session().createDataFrame(rows, "i int, module string, kind string, slope double, shift double").coalesce(1).write.json(
            f"{path}/sigmoids")

    @staticmethod
    def load(path: str) -> CalibratedModel:
        from importlib import import_module
        rows = _session().read.json(f"{path}/sigmoids").orderBy("i").collect()
        return CalibratedModel([
            (getattr(import_module(r["module"]), r["kind"]).load(f"{path}/base={r['i']}"), r["slope"], r["shift"]) for r in rows])


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def calibrate(train: DataFrame, name: str, id_col: str, k: int = 3, **params) -> CalibratedModel:
    """Per fold: fit the base on the other folds, a sigmoid on the held-out scores."""
    folded = split.folds(train, "label", id_col, k).persist()
    parts = []
    for fold in [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]:
        base = fit(folded.where(F.col("fold") != fold).drop("fold"), name, **params)
        held = score(base, folded.where(F.col("fold") == fold))
        one = VectorAssembler(inputCols=["score"], outputCol="_x").transform(held.select("label", "score"))
        sigmoid = LogisticRegression(featuresCol="_x", labelCol="label", standardization=False).fit(one)
        parts.append((base, float(sigmoid.coefficients[0]), float(sigmoid.intercept)))
    folded.unpersist()
    return CalibratedModel(parts)


def _fit_sides(folded: DataFrame, id_col: str, fit_rows: int | None) -> dict[int, DataFrame]:
    """What a fit reads for each held-out fold: the other folds, at most ``fit_rows`` rows of them where a caller asks for a bound."""
    sides = {}
    for fold in [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]:
        others = folded.where(F.col("fold") != fold)
        sides[fold] = split.bounded(others, id_col, fit_rows).persist() if fit_rows else others
    return sides


def _search(train: DataFrame, id_col: str, settings: list[dict], k: int, parallelism: int, fit_rows: int | None):
    """Mean held-out F1 of every setting over all rows; a few fits run side by side."""
    folded = split.folds(train.select(id_col, "label", "features"), "label", id_col, k).persist()
    sides = _fit_sides(folded, id_col, fit_rows)
    f1: list[list[float]] = [[] for _ in settings]
    for fold, side in sides.items():
        bins = bin_rows(side)
        rest = folded.where(F.col("fold") == fold)

        def held_out(task: tuple[dict, list[int]]) -> None:
            largest, group = task
            model = fit(side, "random_forest", **largest, bins=bins)
            for i in group:
                held = score(model if settings[i] == largest else model.limited(**{**largest, **settings[i]}), rest)
                f1[i].append(metrics(confusion_counts(held, [], F.col("score") >= 0.5), 12).first()["f1"])

        with ThreadPool(parallelism) as pool:
            pool.map(held_out, shared(settings, bins), chunksize=1)
        bins.close()
    means = [sum(values) / len(values) for values in f1]
    best = max(range(len(settings)), key=lambda i: means[i])
    model = fit(split.bounded(folded, id_col, fit_rows) if fit_rows else folded, "random_forest", **settings[best])
    for kept in (*sides.values(), folded):
        kept.unpersist()
    return model, {n: str(v) for n, v in settings[best].items()}, means


def grid_search(train: DataFrame, id_col: str, space: dict | None = None, k: int = 3, parallelism: int = 4,
                fit_rows: int | None = None):
    """(best model, best parameters, mean F1 of every setting) over the full grid.

    ``fit_rows`` bounds the rows that each fit reads; every held-out row is scored.
    """
    space = space or GRID
    settings = [dict(zip(space, values)) for values in product(*space.values())]
    return _search(train, id_col, settings, k, parallelism, fit_rows)


def random_search(train: DataFrame, id_col: str, space: dict | None = None, draws: int = RANDOM_DRAWS, k: int = 3, parallelism: int = 4,
                  fit_rows: int | None = None):
    """As ``grid_search`` over a seeded draw of distinct settings."""
    space = space or RANDOM_SPACE
    rng = random.Random(SEED)
    chosen: list[dict] = []
    while len(chosen) < min(draws, math.prod(len(v) for v in space.values())):
        setting = {name: rng.choice(values) for name, values in space.items()}
        if setting not in chosen:
            chosen.append(setting)
    return _search(train, id_col, chosen, k, parallelism, fit_rows)


def cross_predict(df: DataFrame, id_col: str, names: dict[str, dict], k: int = 5, fit_rows: int | None = None,
                  parallelism: int = 4) -> DataFrame:
    """Out-of-fold (id, label, score, model, fold) of every model and row; a fit reads at most ``fit_rows`` rows."""
    folded = split.folds(df.select(id_col, "label", "features"), "label", id_col, k).persist()
    sides = _fit_sides(folded, id_col, fit_rows)

    def held_out(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        model = fit(sides[fold], name, **names[name])
        held = score(model, folded.where(F.col("fold") == fold))
        cut = 0.0 if name == "linear_svm" else 0.5
        return held.select(F.col(id_col).alias("id"), "label", (F.col("score") - cut + 0.5).alias("score"), F.lit(name).alias("model"), "fold")

    with ThreadPool(parallelism) as pool:  # fits of one model wait for others, not for their turn
        parts = pool.map(held_out, [(name, fold) for name in names for fold in sides], chunksize=1)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_cross_validated(df: DataFrame, id_col: str, names: dict[str, dict], k: int = 5, fit_rows: int | None = None) -> DataFrame:
    return cross_validated(cross_predict(df, id_col, names, k, fit_rows), 0.5)


def transfer(df: DataFrame, dataset: str, name: str = "random_forest", **params) -> DataFrame:
    """Train on one data set, score another, for every ordered pair of data sets with two classes."""
    sets = [r[0] for r in df.groupBy(dataset).agg(F.countDistinct("label").alias("c")).where("c > 1").select(dataset).orderBy(dataset).collect()]
    parts = []
    for source in sets:
        model = fit(df.where(F.col(dataset) == source), name, **params)
        others = score(model, df.where((F.col(dataset) != source) & F.col(dataset).isin(*sets)))
        parts.append(others.withColumn("train_set", F.lit(source)).withColumn("test_set", F.col(dataset)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def importances(model, features: PipelineModel, top: int = 10) -> DataFrame:
    """Most important features by name."""
    names = feature_names(features)
    values = model.importances
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))[:top]
    return _session().createDataFrame(rows, "feature string, importance double")


def principal_components(df: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """All rows on the first k components, and the variance each explains."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(df)
    out = model.transform(df).withColumn("_a", vector_to_array("pc"))
    cols = [F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)]
    return out.select(*[c for c in df.columns if c != "features"], *cols), [float(v) for v in model.explainedVariance]


def params_text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)
