import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghelm.operators import evaluate as ev
from loghelm.operators import split
from loghelm.operators.ranking import hash_bucket, order_scale, ranged, running_totals


def scores(spark, rows):
    return spark.createDataFrame([(i, y, float(s), "m") for i, (y, s) in enumerate(rows)], "id int, label int, score double, model string")


def random_rows(seed, n, ties=True):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.3), round(rng.random(), 2 if ties else 9)) for _ in range(n)]


@pytest.mark.parametrize("ties", [True, False])
def test_auc_equals_pair_counting(spark, ties):
    rows = random_rows(3, 300, ties)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = ev.curve_areas(scores(spark, rows), ["model"]).first()
    assert got["roc_auc"] == pytest.approx(want, abs=1e-6)
    flipped = ev.curve_areas(scores(spark, [(y, -s) for y, s in rows]), ["model"]).first()
    assert flipped["roc_auc"] == pytest.approx(1 - want, abs=1e-6)


def test_percentiles_interpolate(spark):
    rows = random_rows(4, 257)
    got = {r["percentile"]: r["score"] for r in ev.percentiles(scores(spark, rows), ["model"]).collect()}
    for p in ev.PERCENTILES:
        assert got[p] == pytest.approx(np.percentile([s for _, s in rows], p), abs=1e-6)


def test_calibration_bins_close_on_the_right(spark):
    got = {r["bin"]: r["rows"] for r in ev.calibration_curve(scores(spark, [(0, 0.0), (0, 0.1), (1, 0.100001), (1, 1.0)]), ["model"]).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_single_class_and_equal_scores(spark):
    got = ev.curve_areas(scores(spark, [(1, 0.5)] * 5), ["model"]).first()
    assert got["roc_auc"] == 0.0 and got["average_precision"] == 1.0
    same = ev.curve_areas(scores(spark, [(i % 2, 0.5) for i in range(10)]), ["model"]).first()
    assert same["roc_auc"] == 0.5
    assert ev.histogram(scores(spark, [(1, 0.5)] * 5), ["model"], 20).agg(F.sum("rows")).first()[0] == 5


def test_gate_without_a_passing_threshold(spark):
    row = ev.deployment_gate(scores(spark, [(i % 2, 0.5) for i in range(40)]), ["model"]).first()
    assert row["deployment_status"] == "FAILED" and row["best_threshold"] is None and row["threshold"] == 0.55


def test_gate_passes(spark):
    row = ev.deployment_gate(scores(spark, [(1, 0.9)] * 20 + [(0, 0.2)] * 20), ["model"]).first()
    assert row["deployment_status"] == "DEPLOYED" and row["threshold"] == 0.25 and row["f1"] == 1.0


def test_cells_sum_to_rows(spark):
    rows = random_rows(5, 200)
    sweep = ev.threshold_sweep(scores(spark, rows), ["model"], ev.grid("full")).collect()
    assert len(sweep) == 21 and all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 200 for r in sweep)
    for r in sweep:
        assert r["tp"] == sum(1 for y, s in rows if y and s >= r["threshold"])


def test_running_totals_with_a_hot_key_and_nulls(spark):
    rng = random.Random(6)
    rows = [(None if rng.random() < 0.2 else "hot", i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    out = running_totals(ranged(df, [], "o"), ["k"], [F.col("o")], {"run": F.col("v")}, F.col("_range"), {"all": "run"}).collect()
    assert len(out) == 500
    seen = {}
    for r in sorted(out, key=lambda r: r["o"]):
        seen[r["k"]] = seen.get(r["k"], 0) + r["v"]
        assert r["run"] == seen[r["k"]]
    assert all(r["all"] == seen[r["k"]] for r in out)


def test_folds_and_split_keep_class_shares(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(700)], "id int, label int")
    for r in split.folds(df, "label", "id", 5).groupBy("fold").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect():
        assert abs(r["p"] - 20) <= 1 and abs(r["n"] - 140) <= 2
    sides = split.train_test(df, "label", "id", 0.3).agg(
        F.count_if("is_test").alias("t"), F.count_if(F.col("is_test") & (F.col("label") == 1)).alias("p")).first()
    assert sides["t"] == 210 and sides["p"] == 30
    tiny = split.train_test(df.limit(10), "label", "id", small_data=True)
    assert tiny.where("is_train AND is_test").count() == 10
    assert split.fold_count(df.where("id < 15"), "label", 5) == 3


def test_hash_bucket_follows_the_digest(spark):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("h")).select("h", hash_bucket(F.col("h")).alias("b"))
    rows = [(r["h"], r["b"]) for r in df.orderBy("h").collect()]
    assert [b for _, b in rows] == sorted(b for _, b in rows)


def odd_numbers():
    rng = random.Random(11)
    tight = [0.5 + rng.randrange(1000) * 1e-9 for _ in range(400)]
    wide = [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(300)]
    return tight + wide + [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308, 0.1, 0.9999999999999999, 1.0]


def test_order_scale_never_falls(spark):
    import math
    rows = spark.createDataFrame([(x,) for x in odd_numbers()], "x double").select("x", order_scale(F.col("x")).alias("y")).collect()
    rows = sorted(((r["x"], r["y"]) for r in rows), key=lambda r: (math.isnan(r[0]), r[0]))
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("per_octave, rows_each", [(16, 5), (4096, 50), (1, 1), (64, 1_000_000)])
def test_ranks_by_cells_of_any_size(spark, per_octave, rows_each):
    """Buckets rise with the value; a model whose scores lie within a millionth is cut like any other."""
    numbers = [x for x in odd_numbers() if x == x]
    df = spark.createDataFrame([(m, x) for m in ("a", "b") for x in sorted(set(numbers))], "model string, x double").repartition(5)
    cut = ranged(df, ["model"], "x", per_octave=per_octave, rows_each=rows_each)
    rows = sorted((r["model"], r["x"], tuple(r["_range"])) for r in cut.collect())
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])
    falling = sorted((r["model"], r["x"], tuple(r["_range"])) for r in ranged(df, ["model"], "x", True, per_octave, rows_each).collect())
    assert all(a[2] >= b[2] for a, b in zip(falling, falling[1:]) if a[0] == b[0])
    if rows_each <= 50:
        tight = Counter(r[2] for r in rows if r[0] == "a" and 0.5 <= r[1] < 0.500001)
        assert len(tight) >= 200 / rows_each and max(tight.values()) <= 4 * rows_each
    out = running_totals(cut, ["model"], [F.col("x")], {"place": F.lit(1)}, F.col("_range")).collect()
    want = {x: i for i, x in enumerate(sorted({r[1] for r in rows}), 1)}
    assert all(r["place"] == want[r["x"]] for r in out)


def test_whole_numbers_beyond_doubles_are_ranked(spark):
    ids = [2**62 + i for i in range(200)] + [-(2**62) - i for i in range(200)] + [-1, 0, 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    out = running_totals(ranged(df, [], "id", rows_each=10), [], [F.col("id")], {"place": F.lit(1)}, F.col("_range")).collect()
    assert {r["id"]: r["place"] for r in out} == {x: i for i, x in enumerate(sorted(ids), 1)}


def test_plans_of_curves_run_no_job(spark):
    from loghelm.operators import evaluate as ev
    df = spark.createDataFrame([("a", 0.1, 1), ("a", None, 0)], "model string, score double, label int")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for plan in (ev.pr_curve(df, ["model"]), ev.roc_curve(df, ["model"]), ev.percentiles(df, ["model"]), ev.curve_areas(df, ["model"])):
        assert plan.columns
    assert len(tracker.getJobIdsForGroup(None)) == before
