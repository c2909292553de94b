import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghelm.llm.toxicity import fit, score_toxicity, swapped
from loghelm.llm.words import Texts

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = score_toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    test = [(known[r["doc_id"]], r["score"]) for r in found if r["held_out"] and r["doc_id"] in known]
    toxic, clean = [s for t, s in test if t], [s for t, s in test if not t]
    better = np.mean([a > b for a in toxic for b in clean])
    assert better > 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_held_out_accuracy_of_other_sizes(spark, size):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', size)}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('sf0.001', size)}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [(known[r["doc_id"]], r["score"]) for r in score_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in known]
    toxic, clean = [s for t, s in test if t], [s for t, s in test if not t]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= 0.5 for s in clean]) < 0.02


def test_one_doc_id_on_two_texts_is_repeatable(spark, docs, labels):
    twice = docs.union(docs.withColumn("text", F.concat(F.lit("moron "), F.reverse("text"))))
    first, second = (sorted(score_toxicity(d, labels).collect(), key=str) for d in (twice.coalesce(1), twice.repartition(7)))
    assert [(r["doc_id"], round(r["score"], 9)) for r in first] == [(r["doc_id"], round(r["score"], 9)) for r in second]


def test_held_out_labels_are_not_read(spark, docs, labels):
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    other = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(score_toxicity(docs, x).collect(), key=str) for x in (labels, other))
    assert first == second


def test_swapped_terms():
    assert swapped(b"Muslim men and women", 0) == b"jewish women and man".replace(b"man", b"men")
    assert swapped(b"nothing here", 0) is None and swapped(b"manly", 0) is None


def test_penalty_frees_neutral_mentions():
    rng = np.random.default_rng(2)
    word = lambda: "w%d" % rng.integers(200)
    texts, label = [], []
    for i in range(600):
        toxic = i % 2
        words = [word() for _ in range(8)] + (["vile"] if toxic else []) + (["muslim"] if rng.random() < (0.8 if toxic else 0.05) else [])
        texts.append(" ".join(words).encode())
        label.append(toxic)
    from loghelm.llm.toxicity import feature_codes
    codes = np.unique(np.concatenate([c for c in feature_codes(Texts([b"vile muslim christian jewish hindu buddhist atheist"]))]))
    neutral = Texts([b"a muslim here", b"a christian here"])
    spread = []
    for penalty in (0.0, 20.0, 1.0):
        score = fit(texts, np.array(label, float), codes, 0.5, penalty).score(neutral)
        spread.append(abs(score[0] - score[1]))
    assert spread[1] < 0.25 * spread[0] and spread[2] < 0.5 * spread[0]


def test_one_class_and_no_rows(docs, rows, nothing, labels):
    assert {r["score"] for r in score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert score_toxicity(docs, labels).count() == len(rows)
    assert score_toxicity(nothing, labels).collect() == []
