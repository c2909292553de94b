"""Evaluation, threshold and split queries."""

from pyspark.sql import functions as F

from loghelm.operators import evaluate as ev
from loghelm.operators import split
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

_S = with_views("v_scored")
_BY = ["model"]
_CUT = 0.5


def scored(spark, sf):
    return table(spark, sf, "v_scored")


def _cells(by="model", cut="0.5", src="v_scored"):
    return f"""cells AS (SELECT {by}, count(*) FILTER (label = 0 AND score < {cut}) AS tn, count(*) FILTER (label = 0 AND score >= {cut}) AS fp,
 count(*) FILTER (label = 1 AND score < {cut}) AS fn, count(*) FILTER (label = 1 AND score >= {cut}) AS tp FROM {src} GROUP BY {by})"""


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


_P, _R, _F = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
_METRICS = f"""round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f1,
 round(({_R} + {_div('tn', 'tn + fp')}) / 2, 6) AS balanced_accuracy"""
_WITH = _S.rstrip() + ", " + _cells() + "\n"


@query("confusion_matrix", _WITH + """SELECT model, 0 AS label, 0 AS predicted, tn AS rows FROM cells UNION ALL SELECT model, 0, 1, fp FROM cells
UNION ALL SELECT model, 1, 0, fn FROM cells UNION ALL SELECT model, 1, 1, tp FROM cells""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(scored(spark, sf), _BY, F.col("score") >= _CUT)


@query("classification_metrics", _WITH + f"SELECT model, tn, fp, fn, tp, {_METRICS} FROM cells")
def classification_metrics(spark, sf):
    return ev.metrics(ev.confusion_counts(scored(spark, sf), _BY, F.col("score") >= _CUT))


def _row(name, p, r, f, support):
    return f"SELECT model, '{name}' AS entry, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, {support} AS support FROM cells"


_Z = (_div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fp + fn"))
_O = (_P, _R, _F)
_ACC = _div("tp + tn", "tp + tn + fp + fn")


@query("classification_report", _WITH + " UNION ALL ".join([
    _row("0", *_Z, "tn + fp"), _row("1", *_O, "tp + fn"), _row("accuracy", _ACC, _ACC, _ACC, "tp + tn + fp + fn"),
    _row("macro avg", *[f"({a} + {b}) / 2" for a, b in zip(_Z, _O)], "tp + tn + fp + fn"),
    _row("weighted avg", *[_div(f"{a} * (tn + fp) + {b} * (tp + fn)", "tp + tn + fp + fn") for a, b in zip(_Z, _O)], "tp + tn + fp + fn")]))
def classification_report(spark, sf):
    return ev.classification_report(scored(spark, sf), _BY, F.col("score") >= _CUT)


@query("error_cells", _WITH + """SELECT model, 'TN' AS cell, tn AS rows FROM cells UNION ALL SELECT model, 'FP', fp FROM cells
UNION ALL SELECT model, 'FN', fn FROM cells UNION ALL SELECT model, 'TP', tp FROM cells""")
def error_cells(spark, sf):
    return ev.error_cells(scored(spark, sf), _BY, F.col("score") >= _CUT)


_STEPS = _S.rstrip() + """, pts AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM v_scored GROUP BY 1, 2),
steps AS (SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS ap, sum(neg) OVER (PARTITION BY model) AS an
 FROM pts WINDOW w AS (PARTITION BY model ORDER BY score DESC))
"""


@query("pr_curve", _STEPS + """SELECT model, score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / ap, 6) AS recall FROM steps
UNION ALL SELECT DISTINCT model, NULL, 1.0, 0.0 FROM v_scored""")
def pr_curve(spark, sf):
    return ev.pr_curve(scored(spark, sf), _BY)


@query("roc_curve", _STEPS + "SELECT model, score AS threshold, round(CAST(fp AS DOUBLE) / an, 6) AS fpr, round(CAST(tp AS DOUBLE) / ap, 6) AS tpr FROM steps")
def roc_curve(spark, sf):
    return ev.roc_curve(scored(spark, sf), _BY)


_AUC = """round(sum(CAST(neg AS DOUBLE) * (tp + tp - pos) / 2) / (max(ap) * max(an)), 6) AS roc_auc"""


@query("curve_areas", _STEPS + f"""SELECT model, {_AUC},
 round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp) + coalesce(CAST(tp - pos AS DOUBLE) / nullif(tp - pos + fp - neg, 0), 1.0)) / 2) / max(ap), 6) AS pr_auc,
 round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(ap), 6) AS average_precision, round(CAST(max(ap) AS DOUBLE) / (max(ap) + max(an)), 6) AS base_rate
FROM steps GROUP BY model""")
def curve_areas(spark, sf):
    return ev.curve_areas(scored(spark, sf), _BY)


def _sweep(name):
    first, n = ev.GRIDS[name]
    return _S.rstrip() + f""", grid AS (SELECT round(i * 0.05::DOUBLE, 2) AS threshold FROM (SELECT unnest(range({first}, {first + n})) AS i)),
cells AS (SELECT model, threshold, count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
 count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 1 AND score >= threshold) AS tp FROM v_scored, grid GROUP BY 1, 2),
sweep AS (SELECT model, threshold, tn, fp, fn, tp, {_METRICS} FROM cells)
"""


@query("threshold_sweep", _sweep("full") + "SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(scored(spark, sf), _BY, ev.grid("full"))


@query("best_threshold", _sweep("tuning") + """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn
 FROM sweep WHERE f1 > 0) WHERE rn = 1""")
def best_threshold(spark, sf):
    return ev.best_threshold(ev.threshold_sweep(scored(spark, sf), _BY, ev.grid("tuning")), _BY)


@query("deployment_gate", _sweep("deployment") + """, best AS (SELECT model, threshold AS best_threshold FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn
 FROM sweep WHERE precision >= 0.88 AND recall >= 0.80 AND f1 >= 0.84) WHERE rn = 1)
SELECT model, threshold, best_threshold, precision, recall, f1,
 CASE WHEN precision >= 0.88 AND recall >= 0.80 AND f1 >= 0.84 THEN 'DEPLOYED' ELSE 'FAILED' END AS deployment_status
FROM sweep LEFT JOIN best USING (model) WHERE threshold = coalesce(best_threshold, 0.55)""")
def deployment_gate(spark, sf):
    return ev.deployment_gate(scored(spark, sf), _BY)


@query("precision_target", _STEPS + """, pr AS (SELECT model, score, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / ap AS r FROM steps),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY r DESC, score DESC) AS rn FROM pr WHERE p >= 0.85) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, score DESC) AS rn FROM pr) WHERE rn = 1)
SELECT b.model, a.model IS NOT NULL AS met, coalesce(a.score, b.score) AS threshold, round(coalesce(a.p, b.p), 6) AS precision, round(coalesce(a.r, b.r), 6) AS recall
FROM b LEFT JOIN a USING (model)""")
def precision_target(spark, sf):
    return ev.precision_target(scored(spark, sf), _BY)


@query("size_adaptive_threshold", with_views("v_logs") + """
SELECT service, host, count(*) AS rows, CAST(CASE WHEN count(*) < 20 THEN 0.5 WHEN count(*) < 100 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS threshold FROM v_logs GROUP BY 1, 2""")
def size_adaptive_threshold(spark, sf):
    sized = table(spark, sf, "v_logs").groupBy("service", "host").agg(F.count(F.lit(1)).alias("rows"))
    return sized.withColumn("threshold", ev.size_threshold(F.col("rows")))


@query("calibration_curve", _S + """SELECT model, CAST(""" + " + ".join(
    f"CAST(score > CAST({i} AS DOUBLE) * CAST(0.1 AS DOUBLE) AS INT)" for i in range(1, 10)) + """ AS INT) AS bin, count(*) AS rows,
 round(avg(label), 6) AS prob_true, round(avg(score), 6) AS prob_pred FROM v_scored GROUP BY 1, 2""")
def calibration_curve(spark, sf):
    return ev.calibration_curve(scored(spark, sf), _BY)


@query("brier_score", _S + "SELECT model, round(avg((score - label) * (score - label)), 6) AS brier FROM v_scored GROUP BY 1")
def brier_score(spark, sf):
    return ev.brier(scored(spark, sf), _BY)


@query("score_histogram", _S.rstrip() + """, e AS (SELECT model, label, min(score) AS lo, max(score) AS hi FROM v_scored GROUP BY 1, 2),
c AS (SELECT model, label, CAST(least(floor((score - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS rows FROM v_scored JOIN e USING (model, label) GROUP BY 1, 2, 3),
every_ AS (SELECT model, label, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(unnest(range(30)) AS INT) AS bin FROM e)
SELECT model, label, bin, lo, hi, coalesce(rows, 0) AS rows FROM every_ LEFT JOIN c USING (model, label, bin)""")
def score_histogram(spark, sf):
    return ev.histogram(scored(spark, sf), ["model", "label"], 30)


@query("score_percentiles", _S + " UNION ALL ".join(
    f"SELECT model, {p} AS percentile, round(quantile_cont(score, {p / 100}), 6) AS score FROM v_scored GROUP BY 1" for p in ev.PERCENTILES))
def score_percentiles(spark, sf):
    return ev.percentiles(scored(spark, sf), _BY)


@query("score_range", _S + """SELECT model, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score,
 round(median(score), 6) AS median_score FROM v_scored GROUP BY 1""")
def score_range(spark, sf):
    return ev.score_range(scored(spark, sf), _BY)


@query("compare_models", _STEPS.rstrip() + ", " + _cells() + f""", auc AS (SELECT model, {_AUC} FROM steps GROUP BY model)
SELECT model, accuracy, precision, recall, f1, roc_auc FROM (SELECT model, {_METRICS} FROM cells) JOIN auc USING (model)""")
def compare_models(spark, sf):
    return ev.compare_models(scored(spark, sf), _CUT)


_PLACE = """placed AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS place, count(*) OVER (PARTITION BY {by}) AS part_rows FROM {src})"""


@query("cross_validated_models", _S.rstrip() + ", " + _PLACE.format(by="model, label", src="v_scored") + ", folded AS (SELECT *, (place - 1) % 5 AS fold FROM placed), "
       + _cells("model, fold", src="folded") + f""", m AS (SELECT model, fold, {_P} AS p, {_R} AS r, {_F} AS f FROM cells)
SELECT model, count(*) AS n_splits, round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_std, round(avg(r), 6) AS recall_mean,
 round(stddev_pop(r), 6) AS recall_std, round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_std FROM m GROUP BY model""")
def cross_validated_models(spark, sf):
    return ev.cross_validated(split.folds(scored(spark, sf), "label", "id", 5, within=["model"]), _CUT)


@query("cross_dataset_metrics", with_views("v_scored").rstrip() + ", t AS (SELECT s.*, CASE WHEN id % 2 = 0 THEN 'hdfs' ELSE 'bgl' END AS test_set FROM v_scored s), "
       + _cells("model, test_set", src="t") + f" SELECT model, test_set, tn, fp, fn, tp, {_METRICS} FROM cells")
def cross_dataset_metrics(spark, sf):
    tagged = scored(spark, sf).withColumn("test_set", F.expr("CASE WHEN id % 2 = 0 THEN 'hdfs' ELSE 'bgl' END"))
    return ev.metrics(ev.confusion_counts(tagged, ["model", "test_set"], F.col("score") >= _CUT))


@query("prediction_listing", _S + "SELECT id, model, CASE WHEN score >= 0.65 THEN 'ANOMALY (1)' ELSE 'NORMAL (0)' END AS prediction, round(score, 4) AS prob FROM v_scored")
def prediction_listing(spark, sf):
    return ev.listing(scored(spark, sf), 0.65).select("id", "model", "prediction", "prob")


@query("confidence_scatter", _S + """SELECT id, score, label, CAST(0.7 AS DOUBLE) AS threshold FROM v_scored WHERE model = 'prob'
ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 800""")
def confidence_scatter(spark, sf):
    from loghelm.operators.query import uniform_sample
    return uniform_sample(scored(spark, sf).where("model = 'prob'"), "id", 800).select("id", "score", "label", F.lit(0.7).alias("threshold"))


_C = with_views("v_corpus")


@query("train_test_split", _C.rstrip() + ", " + _PLACE.format(by="true_label", src="v_corpus") + """
SELECT id, true_label, place <= ceil(0.3::DOUBLE * part_rows) AS is_test, NOT (place <= ceil(0.3::DOUBLE * part_rows)) AS is_train FROM placed""")
def train_test_split(spark, sf):
    return split.train_test(table(spark, sf, "v_corpus"), "true_label", "id", 0.3).select("id", "true_label", "is_test", "is_train")


@query("stratified_folds", _C.rstrip() + ", " + _PLACE.format(by="true_label", src="v_corpus") + " SELECT id, true_label, CAST((place - 1) % 5 AS INT) AS fold FROM placed")
def stratified_folds(spark, sf):
    return split.folds(table(spark, sf, "v_corpus"), "true_label", "id").select("id", "true_label", "fold")


@query("class_weights", _C + "SELECT true_label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM v_corpus GROUP BY true_label")
def class_weights(spark, sf):
    return split.class_weights(table(spark, sf, "v_corpus"), "true_label").withColumn("weight", F.round("weight", 6))
