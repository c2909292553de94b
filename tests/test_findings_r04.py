"""What the findings of round 4 name."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from loghelm.operators.correlate import MICROS, SSH_BRUTEFORCE


class _State:
    """Keyed state in memory that counts its writes."""

    def __init__(self):
        self.held, self.timers, self.writes = {}, set(), 0

    def _of(self, name):
        mine, put = self.held.setdefault(name, {}), self._put
        return SimpleNamespace(
            exists=lambda: () in mine, get=lambda: mine[()], update=lambda v: put(mine, (), v), clear=lambda: mine.pop((), None),
            getValue=mine.__getitem__, containsKey=mine.__contains__, updateValue=lambda k, v: put(mine, k, v),
            removeKey=mine.pop, keys=lambda: iter(list(mine)))

    def _put(self, mine, key, value):
        self.writes += 1
        mine[key] = value

    def getValueState(self, name, *schemas):
        return self._of(name)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.writes += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def passed(self, processor, key, ms):
        """Fires timers up to the watermark until none is left."""
        out = []
        while due := [t for t in self.timers if t <= ms]:
            self.timers.discard(min(due))
            out += processor.handleExpiredTimer(
                key, SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), SimpleNamespace(getExpiryTimeInMs=lambda: min(due)))
        return pd.concat(out) if out else pd.DataFrame(columns=["ip", "us", "id"])


@pytest.mark.parametrize("step", [30_000, 10**9])
def test_events_of_many_signatures_and_slices_share_their_state_calls(step):
    from loghelm.streaming.correlation import RepeatChain, SlidingCount
    rng, gap, window = random.Random(7), SSH_BRUTEFORCE.dedup_seconds * MICROS, SSH_BRUTEFORCE.window_seconds * MICROS
    rows = [(f"10.0.0.{rng.randrange(2)}", f"s{rng.randrange(40)}", rng.randrange(900) * MICROS, i) for i in range(2000)]
    rows = [r for r in rows if r[1] != "s0"] + [("10.0.0.9", "s0", 5 * MICROS, 5001), ("10.0.0.9", "s0", 5 * MICROS, 5000)]
    key, state, chain = ("ssh_bruteforce", 3), _State(), RepeatChain([SSH_BRUTEFORCE])
    chain.init(state)
    made = pd.DataFrame(rows, columns=["ip", "sig", "us", "id"]).assign(payload="{}")
    list(chain.handleInputRows(key, iter([made.iloc[:700], made.iloc[700:]]), None))
    kept = pd.concat([state.passed(chain, key, min(ms, 10**7)) for ms in range(0, 10**6 + step, step)])
    want, last = [], {}
    for ip, sig, us, i in sorted(rows, key=lambda r: r[2:]):
        if us > last.get((ip, sig), -10**15) + gap:
            want.append((ip, us, i))
            last[ip, sig] = us
    assert sorted(zip(kept["ip"], kept["us"], kept["id"])) == sorted(want)
    assert not state.held["chunks"]
    if step == 10**9:  # one pass of the watermark: far fewer calls than the 2,000 events, 60 slices, 80 signatures
        assert state.writes < 30

    state, counts = _State(), SlidingCount([SSH_BRUTEFORCE])
    counts.init(state)
    size = 4 * window
    own = [(ip, us // size, us, i, True, "{}") for ip, us, i in want]
    later = [(ip, (us + window) // size, us, i, False, None) for ip, us, i in want if (us + window) // size != us // size]
    dealt = pd.DataFrame(own + later, columns=["ip", "slice", "us", "id", "own", "payload"])
    list(counts.handleInputRows(key, iter([dealt]), None))
    got = pd.concat([state.passed(counts, key, ms) for ms in range(0, 2 * 10**6 + step, step)])
    brute = {i: sum(a == ip and us - window <= u and (u, j) <= (us, i) for a, u, j in want) for ip, us, i in want}
    assert dict(zip(got["id"], got["active_event_count"])) == brute
    assert np.all(got["rule"] == "ssh_bruteforce")



def _noisy(spark, n):
    """Few features, so that many rows are equal, and labels that they tell in part."""
    from pyspark.ml.linalg import Vectors
    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.2 + 0.2 * (i % 4)), Vectors.sparse(6, sorted({i % 6: 1.0 + i % 4, (i + 1) % 5: float(rng.randrange(1, 4))}.items())))
            for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "features"])


def test_a_forest_is_fitted_on_all_rows_however_many(spark):
    """Rows that only the end of a table in hash order holds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from loghelm.operators.ml import forest
    n = 21_000
    late = (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64("id"))) > 20_000).cast("int")
    rows = spark.range(n).select("id", late.alias("label"), late.cast("double").alias("x"), (F.col("id") % 7 + 1.0).alias("y"))
    train = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows).select("id", "label", "features").persist()
    bins = forest.bin_rows(train)
    held = bins.sent.value.load()
    assert (held.size.sum(), held.size[held.label == 1].sum(), len(held.size)) == (n, 1_000, 14)
    model = forest.fit_forest(train, numTrees=4, featureSubsetStrategy="all", bins=bins)
    bins.close()
    got = {(r["label"], r["score"]) for r in model.add_score(train, "score").select("label", "score").collect()}
    assert got == {(0, 0.0), (1, 1.0)}
    train.unpersist()


def test_equal_rows_as_one_give_trees_that_bounds_cut_off(spark, monkeypatch):
    from loghelm.operators.ml import forest
    monkeypatch.setattr(forest, "DRIVER_ROWS", 100)
    rows = _noisy(spark, 1_500)
    bins = forest.bin_rows(rows)
    held = bins.sent.value.load()
    assert held.size.sum() == 1_500 and len(held.size) < 500
    times, drawn = forest._bootstrap(len(held.size), held.size, np.random.default_rng(1))
    assert times.sum() == 1_500 and (drawn <= times).all() and (drawn <= held.size).all() and 0.6 < drawn.sum() / 1_500 < 0.66
    monkeypatch.setattr(forest, "DRAWN_ROWS", 100)
    assert forest._bootstrap(len(held.size), held.size, np.random.default_rng(1))[0].sum() == 1_500
    monkeypatch.undo()

    whole = forest.grow(held, 9, None, 2, 1, "sqrt")
    monkeypatch.setattr(forest, "NODE_VALUES", 50)
    pieces = forest.grow(held, 9, None, 2, 1, "sqrt")
    assert all(np.allclose(whole[c], pieces[c]) for c in whole)
    settings = [{"numTrees": t, "maxDepth": d, "minInstancesPerSplit": m, "minInstancesPerNode": 2} for t in (3, 5) for d in (None, 4) for m in (2, 60)]
    ((largest, group),) = forest.shared(settings, bins)
    assert largest == {"numTrees": 5, "maxDepth": None, "minInstancesPerSplit": 2, "minInstancesPerNode": 2} and len(group) == 8
    scores = lambda model: {r["id"]: round(r["s"], 9) for r in model.add_score(rows, "s").select("id", "s").collect()}
    every = forest.fit_forest(rows, **largest, bins=bins)
    for setting in settings[1::2]:
        assert scores(every.limited(**setting)) == scores(forest.fit_forest(rows, **setting, bins=bins))
    bins.close()


def test_no_model_query_bounds_the_rows_of_its_fits(spark, sf, monkeypatch):
    from loghelm.operators import split
    from loghelm.operators.ml import models, retrain
    from loghelm.plans import model_plans as plans
    fitted, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda train, *a, **b: (fitted.append(train.count()), fit(train, *a, **b))[1])

    def refuse(*_, **__):
        raise AssertionError("rows of a fit are bounded")
    monkeypatch.setattr(split, "bounded", refuse)
    small = {"numTrees": [1, 2], "maxDepth": [2]}
    monkeypatch.setattr(models, "GRID", small)
    monkeypatch.setattr(plans, "SETS", {"logreg": {"maxIter": 3}})
    monkeypatch.setattr(models.fit_forest, "__defaults__", (3, *models.fit_forest.__defaults__[1:]))
    train = plans._sides(spark, sf)[0].count()
    assert plans.random_forest_scores(spark, sf).count() > 0 and fitted == [train]
    assert plans.scores_with_fallback(spark, sf).count() > 0 and fitted == [train, train]
    fitted.clear()
    assert plans.forest_grid_search(spark, sf).first()["settings"] == 2
    assert sum(fitted[:3]) == 2 * train and fitted[3] == train  # three folds, each without its own rows; then all
    assert plans.model_cross_validation(spark, sf).first()["n_splits"] == 5
    fitted.clear()
    assert plans.retraining_run(spark, sf).count() == 1
    assert min(fitted) > 500 and len(fitted) == 3 + 1 + 3


def test_components_read_the_texts_for_their_vectors_once(spark, sf):
    from loghelm.plans import model_plans as plans
    files = plans.principal_components(spark, sf).inputFiles()
    assert files and all("/vectors-" in f for f in files)
