"""Model queries. Training is iterative, so these have no SQL twin."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from loghelm.operators import evaluate as ev
from loghelm.operators import split
from loghelm.operators.ml import isolation, models, retrain, stages
from loghelm.plans.registry import query
from loghelm.plans.views import table
from loghelm.session import cut_lineage, scratch_path

# Models run at their full settings, the operators' defaults, and every fit reads all
# its rows: no bound on the rows of a fit, or of each of the many fits of a search.
FIT_ROWS = None
SEARCH_ROWS = None
# What the two made versions of ``deployed_model_scores`` are fitted on.
VERSION_FEATURE_ROWS, VERSION_ROWS = 20_000, 2_000
SETS = {"random_forest": {}, "logreg": {}, "linear_svm": {}}
FOLDS = 5
TERMS = 3_000


def _labelled(spark, sf):
    """Log messages labelled by event type, with host, service and time."""
    return table(spark, sf, "v_logs").select(
        F.col("event_id").alias("id"), "message", "host", "service", "timestamp",
        F.expr("CAST(event_type = 'error' OR k >= 95 AS INT)").alias("label"))


def _features(df, **over):
    args = {"max_features": TERMS, "numeric": "behaviour", "cleaner": "clean", "categories": ("host",), **over}
    return stages.fit_features(df, **args)


@query("feature_vectors")
def feature_vectors(spark, sf):
    rows = _labelled(spark, sf)
    from pyspark.ml.functions import vector_to_array
    out = stages.featurise(rows, _features(rows))
    values = vector_to_array("features")
    return out.select("id", F.size(values).alias("width"), F.size(F.filter(values, lambda v: v != 0)).alias("filled"))


@query("stop_word_vectors")
def stop_word_vectors(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))
    model = stages.fit_features(rows, max_features=2000, min_df=2, stop_words=True)
    return stages.featurise(rows, model).select("id", F.col("features").cast("string").alias("features"))


def _prepared(rows, features, *keep):
    """Feature rows written once: training goes over them many times."""
    return cut_lineage(stages.featurise(rows, features).select("id", "label", "features", *keep))


def _sides(spark, sf, fit_rows=FIT_ROWS):
    rows = _labelled(spark, sf)
    sides = split.train_test(rows, "label", "id", 0.2).persist(StorageLevel.DISK_ONLY)  # a fit goes over them several times
    features = _features(sides.where("is_train"))
    prepared = _prepared(sides, features, "is_train", "is_test")
    sides.unpersist()
    train = prepared.where("is_train")
    return split.bounded(train, "id", fit_rows) if fit_rows else train, prepared.where("is_test"), features


@query("random_forest_scores")
def random_forest_scores(spark, sf):
    train, test, _ = _sides(spark, sf)
    return models.score(models.fit(train, "random_forest"), test).select("id", "label", F.round("score", 6).alias("score"))


@query("logistic_scores")
def logistic_scores(spark, sf):
    train, test, _ = _sides(spark, sf)
    return models.score(models.fit(train, "logreg"), test).select("id", "label", F.round("score", 6).alias("score"))


@query("scores_with_fallback")
def scores_with_fallback(spark, sf):
    """Model scores, and the keyword score where a row has no message."""
    train, test, _ = _sides(spark, sf)
    texts = _labelled(spark, sf).select("id", F.expr("CASE WHEN id % 10 = 0 THEN NULL ELSE message END").alias("message"))
    scored = models.score_with_fallback(models.fit(train, "logreg"), test.join(texts, "id"))
    return scored.select("id", F.col("message").isNotNull().alias("by_model"), F.round("prob_anomaly", 6).alias("prob_anomaly"))


@query("linear_svm_margins")
def linear_svm_margins(spark, sf):
    train, test, _ = _sides(spark, sf)
    return models.score(models.fit(train, "linear_svm"), test).select("id", "label", F.round("score", 6).alias("score"))


@query("calibrated_svm_scores")
def calibrated_svm_scores(spark, sf):
    train, test, _ = _sides(spark, sf)
    model = models.calibrate(train.select("id", "label", "features"), "linear_svm", "id", 3)
    return model.transform(test).select("id", "label", F.round("score", 6).alias("score"))


@query("model_report")
def model_report(spark, sf):
    train, test, _ = _sides(spark, sf)
    scored = models.score(models.fit(train, "random_forest"), test).withColumn("model", F.lit("random_forest"))
    return ev.classification_report(scored, ["model"], F.col("score") >= 0.5)


@query("model_cross_validation")
def model_cross_validation(spark, sf):
    rows = _labelled(spark, sf)
    prepared = _prepared(rows, _features(rows))
    return models.compare_cross_validated(prepared, "id", SETS, FOLDS, FIT_ROWS)


@query("forest_grid_search")
def forest_grid_search(spark, sf):
    train, _, _ = _sides(spark, sf, None)
    _, best, f1 = models.grid_search(train.select("id", "label", "features"), "id", fit_rows=SEARCH_ROWS)
    return spark.createDataFrame([(models.params_text(best), max(f1), len(f1))], "best_params string, best_f1 double, settings int")


@query("forest_random_search")
def forest_random_search(spark, sf):
    train, _, _ = _sides(spark, sf, None)
    _, best, f1 = models.random_search(train.select("id", "label", "features"), "id", fit_rows=SEARCH_ROWS)
    return spark.createDataFrame([(models.params_text(best), max(f1), len(f1))], "best_params string, best_f1 double, settings int")


@query("isolation_forest_scores")
def isolation_forest_scores(spark, sf):
    rows = _labelled(spark, sf)
    prepared = _prepared(rows, _features(rows, max_features=500))
    share = rows.agg(F.avg("label")).first()[0]
    forest = isolation.fit_isolation(prepared, "id")
    return isolation.flag_share(forest.score(prepared), share).select("id", "label", F.round("score", 6).alias("score"), "is_anomaly_pred")


@query("cross_dataset_transfer")
def cross_dataset_transfer(spark, sf):
    corpus = table(spark, sf, "v_corpus").withColumnRenamed("true_label", "label")
    features = stages.fit_features(corpus, max_features=1000, min_df=2, max_df=0.95, numeric="structured_20", cleaner="identity")
    moved = models.transfer(_prepared(corpus, features, "source_dataset"), "source_dataset")
    return ev.metrics(ev.confusion_counts(moved, ["train_set", "test_set"], F.col("score") >= 0.5))


@query("feature_importance")
def feature_importance(spark, sf):
    train, _, features = _sides(spark, sf)
    return models.importances(models.fit(train, "random_forest"), features, 30)


@query("principal_components")
def principal_components(spark, sf):
    corpus = table(spark, sf, "v_messages")
    features = stages.fit_features(corpus, max_features=300, min_df=2, max_df=0.95, numeric="structured_20")
    # Written once, where equal values take little room: the components take several passes, each over all texts otherwise.
    path = scratch_path(spark, "vectors")
    stages.featurise(corpus, features).select("id", "true_label", "features").write.parquet(path)
    out, share = models.principal_components(spark.read.parquet(path))
    return out.select("id", "true_label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
                      F.lit(round(share[0], 6)).alias("share1"), F.lit(round(share[1], 6)).alias("share2"))


@query("retraining_run")
def retraining_run(spark, sf):
    original = table(spark, sf, "v_corpus")
    feedback = table(spark, sf, "v_feedback").select("seq", F.col("fb_message").alias("message"), F.col("fb_label").alias("true_label"))
    out = retrain.retrain(spark, original, feedback, "seq", scratch_path(spark, "retrain"), "20240201_000000",
                          fit_rows=SEARCH_ROWS)
    return out.withColumn("best_params", F.to_json("best_params"))


@query("deployed_model_scores")
def deployed_model_scores(spark, sf):
    """Two versions are saved and one is promoted; all messages are scored with that one."""
    from loghelm.sources.writers import point_to
    root = scratch_path(spark, "deployed")
    rows = _labelled(spark, sf)
    features = stages.fit_features(split.bounded(rows, "id", VERSION_FEATURE_ROWS), max_features=TERMS, min_df=2, max_df=0.95, sublinear=True)
    train = cut_lineage(stages.featurise(split.bounded(rows, "id", VERSION_ROWS), features).select("id", "label", "features"))
    for version, trees in (("20240101_000000", 50), ("20240201_000000", 10)):
        retrain.save_version(features, models.calibrate(train, "random_forest", "id", 3, numTrees=trees), root, version)
    point_to(spark, f"{root}/models", "20240101_000000", F.lit("20240101_000000"))
    return retrain.DeployedScorer(root).score(rows).select("id", "model_version", F.round("prob_anomaly", 6).alias("prob_anomaly"))
