import numpy as np
from pyspark.sql import functions as F

from loghelm.llm import quality_model
from loghelm.llm.quality_model import LABELLERS, keep_good, label_model, score_quality

SF = "/root/testdata/sf0.001"


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    n, k = 20_000, len(LABELLERS)
    good = rng.random(n) < 0.85
    say_bad = np.where(good[:, None], 0.01, rng.uniform(0.3, 0.8, k)[None, :])
    said = np.where(rng.random((n, k)) < 0.2, 2, np.where(rng.random((n, k)) < say_bad, 0, 1))
    pattern, times = np.unique(said @ 3 ** np.arange(k), return_counts=True)
    posterior, says_bad, share = label_model(pattern, times)
    assert abs(share - 0.85) < 0.03
    assert np.abs(says_bad[1] - 0.01).max() < 0.02
    of = dict(zip(pattern.tolist(), posterior))
    found = np.array([of[p] for p in (said @ 3 ** np.arange(k)).tolist()]) > 0.5
    assert (found == good).mean() > 0.97


def test_agrees_with_labels_it_never_saw(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = {r["doc_id"]: r["kept"] for r in score_quality(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    good, bad = [found[i] for i, q in known.items() if q], [found[i] for i, q in known.items() if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_every_row_scored(docs, rows, nothing):
    found = score_quality(docs).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert score_quality(nothing).collect() == []


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    few = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scored = score_quality(few).where("weak_label >= 0.5")
    # the text that comes first where texts alone are hashed
    first = scored.orderBy(F.xxhash64("hash")).first()["doc_id"]
    text = few.where(F.col("doc_id") == first).first()["text"]
    fit_rows = 40
    copies = spark.range(1_000_000, 1_000_000 + 2 * fit_rows).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    seen = []
    fit = quality_model.fit_linear

    def spy(slots, weights, label, *more, **named):
        seen.extend((s.tobytes(), w.tobytes()) for s, w, good in zip(slots, weights, label) if good >= 0.5)
        return fit(slots, weights, label, *more, **named)

    monkeypatch.setattr(quality_model, "fit_linear", spy)
    score_quality(few.unionByName(copies), fit_rows=fit_rows)
    assert len(seen) == fit_rows // 2
    assert len(set(seen)) >= fit_rows // 4


def test_kept_rows_are_unchanged(docs, nothing):
    stay = keep_good(docs)
    assert stay.columns == docs.columns
    want = score_quality(docs).where("kept").count()
    assert stay.count() == want
    assert stay.exceptAll(docs).count() == 0
    assert keep_good(nothing).collect() == []
