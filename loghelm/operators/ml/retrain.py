"""Retraining with analyst feedback: clean, train, calibrate, gate, record, promote."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.functions.scoring import keyword_score
from loghelm.operators import dedup, split
from loghelm.operators import evaluate as ev
from loghelm.operators.clean import drop_missing, split_vector_like
from loghelm.operators.ml import models, stages
from loghelm.schemas import RETRAIN_SCHEMA
from loghelm.session import cut_lineage

TEST_SHARE = 0.3


def training_rows(original: DataFrame, feedback: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(all usable rows with a unique id, cleaned feedback).

    ``original`` brings its own ids. Feedback keeps one label per message as
    written, so that message identifies it; messages equal but for the white
    space around them all stay. Dumped vectors are set aside.
    """
    clean = drop_missing(dedup.resolve_feedback(feedback, seq), "message", "true_label")
    clean = clean.withColumn("feedback_id", F.sha2("message", 256)).withColumn("message", text.strip(F.col("message")))
    label = F.col("true_label").cast("int").alias("label")
    both = original.select(F.concat(F.lit("o:"), F.col("id").cast("string")).alias("id"), "message", label).unionByName(
        clean.select(F.concat(F.lit("f:"), "feedback_id").alias("id"), "message", label))
    usable, _ = split_vector_like(drop_missing(both, "message", "label"))
    return usable, clean


def retrain(
    spark: SparkSession, original: DataFrame, feedback: DataFrame, seq: str, root: str, version: str,
    space: dict | None = None, max_features: int = 3000, folds: int = 3, fit_rows: int | None = None,
) -> DataFrame:
    """Run one retraining; returns its history row.

    The whole version (features and model) is saved under its own name and the
    pointer moves only when the gate passes, so a failed run changes nothing
    that is in use. ``fit_rows`` bounds the training rows that the search and the
    calibration read, the first in seeded order; the hold-out is scored whole.
    """
    rows, clean = training_rows(original, feedback, seq)
    sides = cut_lineage(split.train_test(rows, "label", "id", TEST_SHARE))
    train, test = sides.where("is_train"), sides.where("is_test")
    features = stages.fit_features(train, max_features=max_features, min_df=2, max_df=0.95, sublinear=True)
    # Written once: the search and the calibration go over it many times.
    prepared = stages.featurise(train, features).select("id", "label", "features")
    prepared = cut_lineage(split.bounded(prepared, "id", fit_rows) if fit_rows else prepared)
    _, best, _ = models.grid_search(prepared, "id", space, folds)
    typed = {k: (int(v) if v.isdigit() else None if v == "None" else v) for k, v in best.items()}
    model = models.calibrate(prepared, "random_forest", "id", folds, **typed)
    scored = model.transform(stages.featurise(test, features)).select("id", "label", "score").withColumn("model", F.lit("candidate"))
    scored = scored.persist()
    sweep = ev.threshold_sweep(scored, ["model"], ev.grid("deployment"))
    best_row = ev.best_threshold(sweep, ["model"], gated=True).select(
        "model", F.col("threshold").alias("best_threshold"), F.col("precision").alias("best_precision"),
        F.col("recall").alias("best_recall"), F.col("f1").alias("best_f1"))
    verdict = ev.deployment_gate(scored, ["model"]).drop("best_threshold")
    size, feedback_rows = rows.count(), clean.count()
    history = verdict.join(best_row, "model", "left").select(
        F.lit(version).alias("timestamp"), F.lit(size).alias("dataset_size"), F.lit(feedback_rows).alias("feedback_samples"),
        "threshold", "precision", "recall", F.col("f1").alias("f1_score"),
        F.create_map(*[F.lit(x) for kv in best.items() for x in kv]).alias("best_params"),
        "best_threshold", "best_precision", "best_recall", "best_f1", "deployment_status")
    row = history.collect()
    scored.unpersist()
    save_version(features, model, root, version)
    out = spark.createDataFrame(row, RETRAIN_SCHEMA)
    out.coalesce(1).write.mode("append").json(f"{root}/history")
    if row[0]["deployment_status"] == "DEPLOYED":
        from loghelm.sources.writers import point_to
        point_to(spark, f"{root}/models", version, F.lit(version))
    return out


def save_version(features: PipelineModel, model: models.CalibratedModel, root: str, version: str) -> None:
    """Features and classifier under the version's own name; nothing in use changes."""
    features.write().save(f"{root}/models/v={version}/features")
    model.save(f"{root}/models/v={version}/classifier")


def load_version(root: str, version: str) -> tuple[PipelineModel, models.CalibratedModel]:
    return PipelineModel.load(f"{root}/models/v={version}/features"), models.CalibratedModel.load(f"{root}/models/v={version}/classifier")


class DeployedScorer:
    """Scores with the version that is deployed when it is asked; a version is loaded once."""

    def __init__(self, root: str):
        self.root, self.version, self.parts = root, None, None

    def score(self, df: DataFrame, message: str = "message") -> DataFrame:
        """Add prob_anomaly and model_version; keyword scores where there is no text, or no version yet."""
        version = deployed_version(df.sparkSession, self.root)
        if version is None:
            return df.withColumns({"prob_anomaly": keyword_score(F.col(message)), "model_version": F.lit("keywords")})
        if version != self.version:
            self.version, self.parts = version, load_version(self.root, version)
        features, model = self.parts
        scored = model.transform(stages.featurise(df, features)).drop("features")
        usable = F.col(message).isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")
        return scored.withColumn("prob_anomaly", F.coalesce(F.when(usable, F.col("score")), keyword_score(F.col(message)))).drop(
            "score").withColumn("model_version", F.lit(version))


def deployed_version(spark: SparkSession, root: str) -> str | None:
    """Version in use, or none before the first success."""
    try:
        return spark.read.parquet(f"{root}/models/pointer").agg(F.max_by("version", "set_at").alias("v")).first()["v"]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
