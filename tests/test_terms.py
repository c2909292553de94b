"""Term counts, vocabularies and weights at a cost that follows the texts."""

import random

import pytest
from pyspark.sql import functions as F

from loghelm.operators import features as ops
from loghelm.operators.ml import stages


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[60 // (i + 1) + 1 for i in range(40)], k=rng.randint(0, 12))) for _ in range(60)]
    # ids 0 and NULL stand for several rows each
    rows = [(None if i % 20 == 7 else 0 if i % 20 == 3 else i, None if i == 5 else t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, message string").persist()


def plain_counts(docs):
    return docs.select("id", F.explode(ops.terms(F.col("message"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_are_counted_in_their_place(spark, docs):
    assert tuples(ops.term_counts(docs, "id", "message")) == tuples(plain_counts(docs))
    alone = docs.where("id > 0")
    plan = ops.term_counts(alone, "id", "message")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("most, min_df, max_df, ties", [(8, 1, 1.0, 100), (8, 1, 1.0, 0), (30, 2, 0.4, 0), (25, 3, 0.2, 100), (10_000, 1, 1.0, 100), (10_000, 2, 0.3, 0)])
def test_the_pruned_vocabulary_is_the_whole_one(spark, docs, monkeypatch, most, min_df, max_df, ties):
    monkeypatch.setattr(ops, "LISTED_TIES", ties)
    n = docs.count()
    kinds = [ops.term_counts(docs, "id", "message", bigrams=b, singles=s) for b, s in ((False, True), (True, False), (True, True))]
    got = [tuple(r) for r in ops.joint_vocabulary(*kinds, n, most, min_df, max_df)]
    assert got == [tuple(r) for r in ops.vocabulary(plain_counts(docs), n, most, min_df, max_df).collect()]


def test_words_with_spaces_are_not_pruned(spark):
    docs = spark.createDataFrame([(1, "a b,c"), (2, "a,b c"), (3, "a,b c")], "id long, message string")
    kinds = [ops.term_counts(docs, "id", "message", "[^,]+", b, s) for b, s in ((False, True), (True, False), (True, True))]
    assert tuple(ops.joint_vocabulary(*kinds, 3, 1)[0]) == ("a b c", 3, 3)


@pytest.mark.parametrize("sublinear", [False, True])
def test_weights_row_by_row(spark, docs, sublinear):
    n, counts = docs.count(), plain_counts(docs)
    vocab = ops.vocabulary(counts, n, 30)
    round_ = lambda df: tuples(df.withColumn("weight", F.round("weight", 9)))
    assert round_(ops.weights(docs, "id", "message", vocab.collect(), n, sublinear)) == round_(ops.tf_idf(counts, vocab, "id", n, sublinear))


def test_feature_fit_takes_equal_counts_by_term_and_keeps_no_token_lists(spark, docs):
    model = stages.fit_features(docs.repartition(7), max_features=25)
    each = docs.withColumn("id", F.monotonically_increasing_id())
    want = [r["term"] for r in ops.vocabulary(plain_counts(each), docs.count(), 25).collect()]
    assert stages.feature_names(model) == want
    # the fixture's table is all that is kept
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= 1
