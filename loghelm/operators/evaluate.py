"""Evaluation of (id, label, score, model[, fold]) rows, per model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.operators.ranking import ranged, running_totals

# Threshold grids (first, steps of 0.05), gate and defaults.
GRIDS = {
    "tuning": (2, 16),
    "evaluation": (2, 17),
    "deployment": (2, 18),
    "full": (0, 21),
}
STEP = 0.05
MIN_PRECISION = 0.88
MIN_RECALL = 0.80
MIN_F1 = 0.85
F1_TOLERANCE = 0.01
FALLBACK_THRESHOLD = 0.55
TARGET_PRECISION = 0.85
PERCENTILES = [50, 60, 70, 80, 90, 95, 99]


def grid(name: str) -> list[float]:
    first, steps = GRIDS[name]
    return [round((first + i) * STEP, 2) for i in range(steps)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame, by: list[str], predicted: Column) -> DataFrame:
    """tn, fp, fn, tp per group: one aggregate, no shuffle beyond the partial counts."""
    y = F.col("label") == 1
    return df.withColumn("_p", predicted).groupBy(*by).agg(
        F.count_if(~y & ~F.col("_p")).alias("tn"), F.count_if(~y & F.col("_p")).alias("fp"),
        F.count_if(y & ~F.col("_p")).alias("fn"), F.count_if(y & F.col("_p")).alias("tp"))


def metrics(counts: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, precision, recall, F1 and balanced accuracy of tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    named = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "f1": f1,
        "balanced_accuracy": (r + ratio(tn, tn + fp)) / 2,
    }
    return counts.select("*", *[F.round(v, digits).alias(n) for n, v in named.items()])


def confusion_matrix(df: DataFrame, by: list[str], predicted: Column) -> DataFrame:
    """Four cells per group as rows."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(p).alias("predicted"), F.col(n).alias("rows"))
        for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]))
    return confusion_counts(df, by, predicted).select(*by, cells)


def error_cells(df: DataFrame, by: list[str], predicted: Column) -> DataFrame:
    cells = F.inline(F.array(*[
        F.struct(F.lit(n.upper()).alias("cell"), F.col(n).alias("rows")) for n in ("tn", "fp", "fn", "tp")]))
    return confusion_counts(df, by, predicted).select(*by, cells)


def classification_report(df: DataFrame, by: list[str], predicted: Column, digits: int = 6) -> DataFrame:
    """Per class precision, recall, F1 and support; accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    neg, pos, n = tn + fp, tp + fn, tn + fp + fn + tp
    zero = (ratio(tn, tn + fn), ratio(tn, neg), ratio(2 * tn, 2 * tn + fp + fn))
    one = (ratio(tp, tp + fp), ratio(tp, pos), ratio(2 * tp, 2 * tp + fp + fn))
    acc = ratio(tp + tn, n)

    def row(name, values, support):
        return F.struct(F.lit(name).alias("entry"), *[
            F.round(v, digits).alias(c) for c, v in zip(("precision", "recall", "f1"), values)], support.alias("support"))

    rows = [
        row("0", zero, neg), row("1", one, pos), row("accuracy", (acc, acc, acc), n),
        row("macro avg", [(a + b) / 2 for a, b in zip(zero, one)], n),
        row("weighted avg", [ratio(a * neg + b * pos, n) for a, b in zip(zero, one)], n),
    ]
    return confusion_counts(df, by, predicted).select(*by, F.inline(F.array(*rows)))


def score_steps(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per distinct score with cumulative tp and fp from the top score down.

    Rows of equal score are counted first, then the distinct scores are summed
    bucket by bucket, so the curve of any number of rows never meets one task.
    Rows without a score take part in no measure.
    Adds pos and neg (own counts) and all_pos and all_neg (of the group).
    """
    points = df.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running_totals(
        ranged(points, by, "score", descending=True), by, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")},
        F.col("_range"), {"all_pos": "tp", "all_neg": "fp"}).drop("_range")


def pr_curve(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """(threshold, precision, recall) points and the closing point (1, 0)."""
    steps = score_steps(df, by)
    points = steps.select(*by, F.col("score").alias("threshold"),
                          F.round(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision"),
                          F.round(ratio(F.col("tp"), F.col("all_pos")), digits).alias("recall"))
    close = df.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(close)


def roc_curve(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    steps = score_steps(df, by)
    return steps.select(*by, F.col("score").alias("threshold"),
                        F.round(ratio(F.col("fp"), F.col("all_neg")), digits).alias("fpr"),
                        F.round(ratio(F.col("tp"), F.col("all_pos")), digits).alias("tpr"))


def curve_areas(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """ROC AUC, PR AUC (trapezoids), average precision and base rate.

    A point's predecessor is its own cumulative counts less its own rows, so
    neighbours need not meet.
    """
    s = score_steps(df, by)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    now = tp / (tp + fp)
    before_tp, before = tp - pos, F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    return s.groupBy(*by).agg(
        F.round(ratio(F.sum(neg * (tp + before_tp) / 2), F.max("all_pos") * F.max("all_neg")), digits).alias("roc_auc"),
        F.round(ratio(F.sum(pos * (now + before) / 2), F.max("all_pos")), digits).alias("pr_auc"),
        F.round(ratio(F.sum(pos * now), F.max("all_pos")), digits).alias("average_precision"),
        F.round(ratio(F.max("all_pos"), F.max("all_pos") + F.max("all_neg")), digits).alias("base_rate"))


def threshold_sweep(df: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """tn, fp, fn, tp at every threshold, in one pass.

    Each row is counted once under the number of thresholds it reaches; the
    few counts per group are then spread over the grid.
    """
    reached = reduce(lambda a, t: a + (F.col("score") >= t).cast("int"), thresholds[1:], (F.col("score") >= thresholds[0]).cast("int"))
    counts = df.groupBy(*by, reached.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    flagged = []
    for i, t in enumerate(thresholds):
        hit = F.col("reached") > i
        flagged.append(F.struct(
            F.lit(t).alias("threshold"),
            F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp")))
    return metrics(counts.groupBy(*by).agg(F.array(*flagged).alias("g")).select(*by, F.inline("g")))


def gate(precision: Column, recall: Column, f1: Column) -> Column:
    return (precision >= MIN_PRECISION) & (recall >= MIN_RECALL) & (f1 >= round(MIN_F1 - F1_TOLERANCE, 2))


def best_threshold(sweep: DataFrame, by: list[str], gated: bool = False) -> DataFrame:
    """Highest F1 above 0, lowest threshold on ties; a group without one has no row."""
    usable = sweep.where("f1 > 0")
    if gated:
        usable = usable.where(gate(F.col("precision"), F.col("recall"), F.col("f1")))
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in by]), F.struct("f1", -F.col("threshold")))
    return usable.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def deployment_gate(df: DataFrame, by: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """Gated best threshold (or the fallback), its metrics and DEPLOYED or FAILED."""
    tried = threshold_sweep(df, by, thresholds or grid("deployment"))
    best = best_threshold(tried, by, gated=True).select(*by, F.col("threshold").alias("best_threshold"))
    used = tried.join(best, by, "left") if by else tried.join(best, F.lit(True), "left")
    used = used.where(F.col("threshold") == F.coalesce("best_threshold", F.lit(FALLBACK_THRESHOLD)))
    passed = gate(F.col("precision"), F.col("recall"), F.col("f1"))
    return used.select(*by, "threshold", "best_threshold", "precision", "recall", "f1",
                       F.when(passed, "DEPLOYED").otherwise("FAILED").alias("deployment_status"))


def precision_target(df: DataFrame, by: list[str], target: float = TARGET_PRECISION) -> DataFrame:
    """Threshold of the highest recall at ``target`` precision, else of the best precision."""
    s = score_steps(df, by).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("all_pos")))
    meets = F.col("precision") >= target
    row = F.struct("score", "precision", "recall")
    picked = s.groupBy(*by).agg(
        F.max_by(F.when(meets, row), F.when(meets, F.struct("recall", "score"))).alias("a"),
        F.max_by(row, F.struct("precision", "score")).alias("b"))
    got = F.coalesce("a", "b")
    return picked.select(*by, F.col("a").isNotNull().alias("met"), got["score"].alias("threshold"),
                         F.round(got["precision"], 6).alias("precision"), F.round(got["recall"], 6).alias("recall"))


def size_threshold(rows: Column) -> Column:
    return F.when(rows < 20, 0.5).when(rows < 100, 0.6).otherwise(0.7)


def calibration_curve(df: DataFrame, by: list[str], bins: int = 10, digits: int = 6) -> DataFrame:
    """Mean score and share of positives per equal-width bin, closed on the right."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    number = reduce(lambda a, e: a + (F.col("score") > e).cast("int"), edges[1:], (F.col("score") > edges[0]).cast("int"))
    return df.groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("label"), digits).alias("prob_true"), F.round(F.avg("score"), digits).alias("prob_pred"))


def brier(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), digits).alias("brier"))


def histogram(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Counts of equal-width bins between each group's own extremes, zero-filled."""
    ends = df.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = F.col("hi") - F.col("lo")
    number = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    # A plain join would move every row to the task of its group.
    counted = df.join(ends, by).groupBy(*by, number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
                        F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
    return every.join(counted, [*by, "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def percentiles(df: DataFrame, by: list[str], points: list[int] | None = None, digits: int = 6) -> DataFrame:
    """Exact percentiles, linear between neighbours.

    Distinct scores carry their rank range, so each wanted rank is found in
    one row; nothing is sorted as a whole. Rows without a score take part in none.
    """
    points = points or PERCENTILES
    points_n = df.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    steps = running_totals(
        ranged(points_n, by, "score"), by, [F.col("score")], {"upto": F.col("n")}, F.col("_range"), {"total": "upto"})
    wanted = F.explode(F.array(*[F.lit(p) for p in points])).alias("percentile")
    ranked = steps.select(*by, "score", "n", "upto", "total", wanted)
    place = F.col("percentile") / 100 * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda rank: (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
    at_low, at_high = F.when(holds(low), F.col("score")), F.when(holds(high), F.col("score"))
    return ranked.where(holds(low) | holds(high)).groupBy(*by, "percentile").agg(
        F.round(F.max(at_low) + (F.max(at_high) - F.max(at_low)) * F.max(place - low), digits).alias("score"))


def score_range(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """min, max, mean and median score."""
    ends = df.groupBy(*by).agg(F.round(F.min("score"), digits).alias("min_score"), F.round(F.max("score"), digits).alias("max_score"),
                               F.round(F.avg("score"), digits).alias("mean_score"))
    return ends.join(percentiles(df, by, [50], digits).select(*by, F.col("score").alias("median_score")), by)


def validation_run(df: DataFrame, threshold: float, name: Column, at: Column) -> DataFrame:
    """One row for a second labelled set of scored rows: precision, recall and F1 of the anomaly class, and the four cells."""
    cells = metrics(confusion_counts(df, [], F.col("score") >= threshold))
    return cells.select(
        name.alias("data_set"), at.alias("validated_at"), F.lit(threshold).alias("threshold"),
        F.col("precision").alias("precision_anomaly"), F.col("recall").alias("recall_anomaly"), F.col("f1").alias("f1_anomaly"),
        "tn", "fp", "fn", "tp")


def compare_models(df: DataFrame, threshold: float, by: str = "model") -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC AUC of every model, best F1 first."""
    m = metrics(confusion_counts(df, [by], F.col("score") >= threshold))
    return m.join(curve_areas(df, [by]).select(by, "roc_auc"), by).select(
        by, "accuracy", "precision", "recall", "f1", "roc_auc").orderBy(F.desc("f1"), by)


def cross_validated(df: DataFrame, threshold: float, by: str = "model", digits: int = 6) -> DataFrame:
    """Mean and population deviation over folds of precision, recall and F1, best F1 first."""
    folds = metrics(confusion_counts(df, [by, "fold"], F.col("score") >= threshold), 12)
    stats = []
    for name in ("precision", "recall", "f1"):
        stats += [F.round(F.avg(name), digits).alias(f"{name}_mean"), F.round(F.stddev_pop(name), digits).alias(f"{name}_std")]
    return folds.groupBy(by).agg(F.count(F.lit(1)).alias("n_splits"), *stats).orderBy(F.desc("f1_mean"), by)


def listing(df: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    return df.withColumn("prediction", F.when(hit, "ANOMALY (1)").otherwise("NORMAL (0)")).withColumn("prob", F.round("score", 4))
