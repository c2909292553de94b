import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loghelm.llm.sharding import grid_of, permuted, row_at, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 97, 1000, 12347])
def test_permutation_and_its_inverse(spark, n):
    grid, size = grid_of(spark, n), F.lit(n).cast("long")
    found = spark.range(n).select("id", permuted(F.col("id"), size, grid, F.lit(5)).alias("p")).select(
        "id", "p", permuted(F.col("p"), size, grid, F.lit(5), inverse=True).alias("back")).collect()
    assert sorted(r["p"] for r in found) == list(range(n))
    assert all(r["id"] == r["back"] for r in found)
    if n > 100:
        assert sum(abs(a["p"] - b["p"]) == 1 for a, b in zip(found, found[1:])) < n / 20


def test_law_rows(spark, docs, rows):
    found = shard_rows(docs, shards=24).collect()
    plain = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(plain(*r[:2]) for r in rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert sorted(map(str, found)) == sorted(map(str, shard_rows(docs.repartition(7), shards=24).collect()))
    place = shard_rows(docs, shards=24).select("row_number", row_at(spark, F.col("shard"), F.col("slot"), len(rows)).alias("back"))
    assert place.where("row_number != back").count() == 0


def test_repeated_rows(spark):
    found = shard_rows(spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text")), shards=3).groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sorted(r["n"] for r in found) == [33333, 33333, 33334]
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in found)


def test_no_rows(nothing):
    assert shard_rows(nothing).collect() == []
