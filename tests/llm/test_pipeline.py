import corpus_pipeline

from loghelm.llm.common import saved
from loghelm.llm.exact_dedup import find_copies
from loghelm.llm.packing import pack_documents
from loghelm.llm.quality_model import score_quality
from loghelm.llm.simhash import near_copies

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_classifier":
            assert docs.count() == score_quality(before).where("kept").count() < before.count()
        elif name == "exact_dedup":
            assert docs.count() == find_copies(before).where("kept").count()
        elif name == "simhash_near_dedup":
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in near_copies(before).select("component_id").collect()}
        elif name == "source_mixing":
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        else:
            assert sorted(map(str, docs.collect())) == sorted(map(str, pack_documents(before).collect()))


def test_run_repeats(spark):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == second
