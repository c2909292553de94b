from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loghelm.llm.mixing import draw_blocks, mix_sources, mixed_documents, source_targets


def water(size, weights=(5, 2, 1)):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        rest, free = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s] + 1e-9]
        if not over:
            return share | capped
        capped |= {s: 3.0 * size[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 3, None: 500}, {"": 10}, {"a": 5, "b": 0, "c": 900, "d": 7, "e": 2, None: 0}])
def test_targets(spark, sizes):
    found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = water(sizes)
    assert {r["source"]: pytest.approx(want[r["source"]]) for r in found} == {r["source"]: r["target"] for r in found}


def test_mix(docs, rows):
    found = mix_sources(docs, block_words=16).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)
    by = defaultdict(int)
    for _, t, _, s, _ in rows:
        by[s] += size(t)
    want = water(by)
    assert sum(r["taken"] for r in found) == pytest.approx(sum(by.values()), abs=len(by))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    named = {i: s for i, _, _, s, _ in rows if i is not None}
    taken = defaultdict(int)
    for r in found:
        if r["doc_id"] is not None:
            assert r["target"] == pytest.approx(want[named[r["doc_id"]]])
            assert r["source_size"] == by[named[r["doc_id"]]]
            taken[named[r["doc_id"]]] += r["taken"]
    for s in by:
        if not any(r[0] is None and r[3] == s for r in rows):
            assert taken[s] == pytest.approx(want[s], abs=1)
    assert sorted(map(str, found)) == sorted(map(str, mix_sources(docs.repartition(5), block_words=16).collect()))


def test_draws_fill_the_slots(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 3333), ("c", 64), ("d", 1)], "source string, size long")
    draws = draw_blocks(source_targets(sizes), 16, 4, 1).collect()
    slots = sorted((r["slot"], r["shard"]) for r in draws)
    assert slots == [(i // 4, i % 4) for i in range(len(draws))]
    times = Counter((r["source_no"], r["epoch"], r["index"]) for r in draws)
    assert max(times.values()) == 1 and max(r["epoch"] for r in draws) <= 2


def test_mixed_documents(docs, rows):
    found = mixed_documents(docs, block_words=16)
    assert found.columns == docs.columns
    words = lambda d, c: {r["doc_id"]: r["n"] for r in d.groupBy("doc_id").agg(F.sum(c).alias("n")).where("n > 0").collect()}
    count = "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')"
    assert words(found.withColumn("w", F.expr(count)), "w") == words(mix_sources(docs, block_words=16), "taken")
    texts = {i: t for i, t, *_ in rows}
    for r in found.where("doc_id is not null").collect():
        own, part = texts[r["doc_id"]], r["text"]
        assert part == own or r["n_chars"] == len(part)
        assert part == own or part in " ".join(own.split()) or set(part.split()) <= set(own.split())


def test_no_rows(nothing):
    assert mix_sources(nothing).collect() == [] and mixed_documents(nothing).collect() == []
