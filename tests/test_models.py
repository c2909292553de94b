import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loghelm.operators import evaluate as ev
from loghelm.operators import features as ops
from loghelm.operators.ml import isolation, models, retrain, stages
from loghelm.plans.views import table


@pytest.fixture(scope="module")
def corpus(spark):
    logs = table(spark, "/root/testdata/sf0.001", "v_logs")
    return logs.select(F.col("event_id").alias("id"), "message", "host", "timestamp",
                       F.expr("CAST(event_type = 'error' OR k >= 97 AS INT)").alias("label")).persist()


@pytest.fixture(scope="module")
def prepared(corpus):
    model = stages.fit_features(corpus, max_features=300, numeric="behaviour", categories=("host",), cleaner="clean")
    return stages.featurise(corpus, model).select("id", "label", "features").persist(), model


@pytest.mark.parametrize("sublinear", [False, True])
def test_vectors_equal_the_relational_weights(spark, corpus, sublinear):
    docs = corpus.select("id", "message")
    n = docs.count()
    counts = ops.term_counts(docs, "id", "message")
    vocab = ops.vocabulary(counts, n, 100000)
    want = {(r["id"], r["term"]): r["weight"] for r in ops.tf_idf(counts, vocab, "id", n, sublinear).collect()}
    model = stages.fit_features(docs, max_features=100000, sublinear=sublinear)
    names = stages.feature_names(model)
    got = {}
    for r in stages.featurise(docs, model).select("id", "features").collect():
        v = r["features"]
        for i, x in zip(v.indices if hasattr(v, "indices") else range(v.size), v.values):
            if x:
                got[(r["id"], names[int(i)])] = float(x)
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_numbers_are_scaled_by_the_population_deviation(prepared):
    rows, model = prepared
    names = stages.feature_names(model)
    at = names.index("msg_length")
    col = vector_to_array("features")[at]
    row = rows.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9
    assert len(names) == rows.select(F.size(vector_to_array("features"))).first()[0]


def test_unknown_category_sets_nothing(spark, corpus, prepared):
    _, model = prepared
    names = stages.feature_names(model)
    strange = stages.featurise(corpus.limit(1).withColumn("host", F.lit("never seen")), model)
    values = strange.select(vector_to_array("features")).first()[0]
    assert all(v == 0 for n, v in zip(names, values) if n.startswith("host="))


def test_pipeline_survives_saving(spark, corpus, tmp_path):
    model = stages.fit_features(corpus, max_features=50, sublinear=True, numeric="structured_10")
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a = stages.featurise(corpus.limit(20), model).select("id", "features").orderBy("id").collect()
    b = stages.featurise(corpus.limit(20), again).select("id", "features").orderBy("id").collect()
    assert a == b


def test_models_separate_the_classes(prepared):
    rows, _ = prepared
    for name, params in {"random_forest": {"numTrees": 10, "maxDepth": 6}, "logreg": {"maxIter": 20}}.items():
        scored = models.score(models.fit(rows, name, **params), rows).withColumn("model", F.lit(name))
        assert ev.curve_areas(scored, ["model"]).first()["roc_auc"] > 0.9


def test_calibrated_model_saves_and_scores_the_same(spark, prepared, tmp_path):
    rows, _ = prepared
    model = models.calibrate(rows, "random_forest", "id", 2, numTrees=5, maxDepth=4)
    model.save(str(tmp_path / "c"))
    a = {r["id"]: r["score"] for r in model.transform(rows).select("id", "score").collect()}
    b = {r["id"]: r["score"] for r in models.CalibratedModel.load(str(tmp_path / "c")).transform(rows).select("id", "score").collect()}
    assert a == b and all(0 <= v <= 1 for v in a.values())


def test_keyword_score_stands_in(spark, corpus, prepared):
    rows, features = prepared
    model = models.fit(rows, "random_forest", numTrees=3, maxDepth=3)
    odd = corpus.limit(1).withColumn("message", F.lit(None).cast("string"))
    out = models.score_with_fallback(model, stages.featurise(odd, features)).first()
    assert out["prob_anomaly"] == 0.40


def test_isolation_forest_finds_the_outlier(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(600).select("id", F.when(F.col("id") == 7, 50.0).otherwise((F.col("id") % 10) / 10.0).alias("a"),
                                 ((F.col("id") * 7) % 13 / 13.0).alias("b"))
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    forest = isolation.fit_isolation(vec, "id", trees=50, sample=600)
    out = isolation.flag_share(forest.score(vec), 1 / 600)
    assert [r["id"] for r in out.orderBy(F.desc("score")).limit(1).collect()] == [7]
    assert out.where("is_anomaly_pred = 1").count() <= 2


def test_a_failed_retraining_moves_no_pointer(spark, corpus, tmp_path):
    original = corpus.select("id", "message", F.expr("CAST(id % 2 AS INT)").alias("true_label"))
    feedback = spark.createDataFrame([(1, "noise a", 1), (2, "noise a", 0)], "seq int, message string, true_label int")
    root = str(tmp_path / "r")
    row = retrain.retrain(spark, original, feedback, "seq", root, "20240101_000000", {"numTrees": [3], "maxDepth": [2]}, 50, 2).first()
    assert row["deployment_status"] == "FAILED" and row["best_threshold"] is None and row["feedback_samples"] == 1
    assert retrain.deployed_version(spark, root) is None
    good = corpus.select("id", "message", F.expr("CAST(message LIKE '%Failed%' AS INT)").alias("true_label"))
    row = retrain.retrain(spark, good, feedback, "seq", root, "20240102_000000", {"numTrees": [20], "maxDepth": [8]}, 50, 2).first()
    assert row["deployment_status"] == "DEPLOYED"
    assert retrain.deployed_version(spark, root) == "20240102_000000"
    assert spark.read.json(f"{root}/history").count() == 2


def test_bounds_hold_for_fits_and_not_for_held_out_rows(spark, sf, monkeypatch):
    from loghelm.plans import model_plans as plans
    n = table(spark, sf, "v_logs").count()
    fitted, held = [], []
    fit, score = models.fit, models.score
    monkeypatch.setattr(models, "fit", lambda train, *a, **b: (fitted.append(train.count()), fit(train, *a, **b))[1])
    monkeypatch.setattr(models, "score", lambda model, df, *a: (held.append(df.count()), score(model, df, *a))[1])
    monkeypatch.setattr(plans, "FIT_ROWS", 90)
    monkeypatch.setattr(plans, "SEARCH_ROWS", 60)
    monkeypatch.setattr(plans, "SETS", {"logreg": {"maxIter": 5}})
    small = {"numTrees": [2], "maxDepth": [3, 4]}
    monkeypatch.setattr(models, "GRID", small)
    monkeypatch.setattr(models, "RANDOM_SPACE", small)
    assert plans.model_cross_validation(spark, sf).first()["n_splits"] == 5
    assert (max(fitted), sum(held)) == (90, n)
    train = plans._sides(spark, sf, None)[0].count()
    for search in (plans.forest_grid_search, plans.forest_random_search):
        fitted.clear(), held.clear()
        assert search(spark, sf).first()["settings"] == 2
        assert (max(fitted), sum(held)) == (60, 2 * train)


def test_components_of_texts_without_a_label(spark, sf):
    from loghelm.plans import model_plans as plans
    want = {r["id"]: r["true_label"] for r in table(spark, sf, "v_messages").select("id", "true_label").collect()}
    found = {r["id"]: r["true_label"] for r in plans.principal_components(spark, sf).collect()}
    assert found == want
    assert None in found.values()
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(found) == events + spark.read.parquet(f"{sf}/documents.parquet").count()


def test_margins_equal_a_dense_solution(spark):
    """Squared hinge with a penalised intercept, against plain Newton steps on a small dense problem."""
    from pyspark.ml.linalg import Vectors

    from loghelm.operators.ml.linear import LinearModel, fit_squared_hinge
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) * (rng.random((300, 12)) < 0.4)
    y = np.where(x[:, 0] - x[:, 1] + 0.6 * rng.standard_normal(300) > 0.3, 1.0, -1.0)
    weight = np.where(y > 0, 1.7, 0.6)
    z, w = np.column_stack([x, np.ones(300)]), np.zeros(13)
    for _ in range(200):
        live = y * (z @ w) < 1
        a = z[live] * weight[live, None]
        grad = w - 2 * a.T @ (y[live] - z[live] @ w)
        w = w - np.linalg.solve(np.eye(13) + 2 * a.T @ z[live], grad)
    rows = [(i, int(t > 0), float(c), Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(12, [(j, float(u)) for j, u in enumerate(v) if u]))
            for i, (v, t, c) in enumerate(zip(x, y, weight))]
    df = spark.createDataFrame(rows, ["id", "label", "weight", "features"]).repartition(40)
    model = fit_squared_hinge(df.persist(), 12)
    got = {r["id"]: r["m"] for r in model.add_score(df, "m").collect()}
    assert all(abs(got[i] - m) < 1e-4 for i, m in enumerate(z @ w))


def binary(spark, rows):
    from pyspark.ml.linalg import Vectors
    return spark.createDataFrame([(i, int(y), Vectors.dense([float(v) for v in x])) for i, (x, y) in enumerate(rows)], ["id", "label", "features"])


def test_trees_grow_beyond_depth_30_and_keep_their_sizes(spark):
    from loghelm.operators.ml.forest import Binned, ForestModel, fit_forest, grow
    from loghelm.operators.ml.vectors import Rows
    stairs = [([i], i % 2) for i in range(60)]  # each step apart from the next one only
    deep = fit_forest(binary(spark, stairs), numTrees=20, featureSubsetStrategy="all")
    chain = Rows.of([None] * 60, [[float(i == j) for j in range(60)] for i in range(60)])
    one_by_one = grow(Binned(chain, np.arange(60) % 2, 60), 1, None, 2, 1, "all")
    assert ForestModel([one_by_one], 60).depth > 10 and deep.depth >= 5
    long = Rows.of([None] * 50, [[1.0 if j >= i else 0.0 for j in range(50)] for i in range(50)])
    fibre = [grow(Binned(long, np.arange(50) % 2, 50), s, None, 2, 1, "log2") for s in range(20)]
    assert max(ForestModel([t], 50).depth for t in fibre) > 8
    single = Rows.of([[i] if i < 199 else [] for i in range(200)], [[1.0] if i < 199 else [] for i in range(200)])
    comb = grow(Binned(single, (np.arange(200) % 2), 199), 5, None, 2, 1, "all")
    assert ForestModel([comb], 199).depth > 30
    flat = grow(Binned(single, (np.arange(200) % 2), 199), 5, 7, 2, 1, "all")
    assert ForestModel([flat], 199).depth == 7
    rng = np.random.default_rng(1)
    noise = [([rng.random(), rng.random(), rng.random()], rng.random() < 0.5) for _ in range(300)]
    table = Rows.of([None] * 300, [v for v, _ in noise])
    labels = np.array([int(t) for _, t in noise])
    for min_split, min_leaf in ((2, 1), (40, 1), (2, 25), (60, 10)):
        for seed in range(4):
            tree = grow(Binned(table, labels, 3), seed, None, min_split, min_leaf, "sqrt")
            taken = np.unique(np.random.default_rng(seed).integers(300, size=300))
            at = {0: taken}
            for node in range(len(tree["feature"])):
                rows, f = at[node], tree["feature"][node]
                assert len(rows) >= min_leaf
                if f >= 0:
                    assert len(rows) >= min_split
                    low = table.dense(0, 300, 3)[rows, f] <= tree["cut"][node]
                    at[int(tree["left"][node])], at[int(tree["left"][node]) + 1] = rows[low], rows[~low]


def test_forest_scores_equal_a_walk_of_each_tree(spark, prepared, tmp_path):
    from loghelm.operators.ml.forest import ForestModel, fit_forest
    rows, _ = prepared
    model = fit_forest(rows, numTrees=7)
    model.save(str(tmp_path / "f"))
    again = ForestModel.load(str(tmp_path / "f"))
    got = {r["id"]: r["score"] for r in again.add_score(rows, "score").select("id", "score").collect()}
    for r in rows.limit(60).collect():
        x, total = r["features"].toArray(), 0.0
        for t in model.trees:
            node = 0
            while t["feature"][node] >= 0:
                node = t["left"][node] + (x[t["feature"][node]] > t["cut"][node])
            total += t["share"][node]
        assert got[r["id"]] == pytest.approx(total / 7)
    assert model.importances.sum() == pytest.approx(1.0)
    scored = model.add_score(rows, "score").withColumn("model", F.lit("f"))
    assert ev.curve_areas(scored, ["model"]).first()["roc_auc"] > 0.99
