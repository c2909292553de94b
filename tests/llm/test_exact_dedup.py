import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loghelm.llm.exact_dedup import CHUNK, find_copies, keep_one, without_white


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, group in groups.items():
        best = min(group)
        for k, member in enumerate(sorted(group)):
            out.append((member[3], best[3], len(group), k == 0, hashlib.sha256(text.encode()).hexdigest(), -member[0]))
    return sorted(out, key=str)


def test_like_brute_force(docs, rows):
    found = find_copies(docs).drop("crc", "hash").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_chunks_rebuild_the_text(spark):
    texts = ["", "a", "x" * 10_000, ("Ab. " * 400 + "É." * 3) * 20, "😀" * 5000, ". A" * 3000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", without_white(F.col("text")).alias("n"))
    for r in frame.select("text", "n", F.regexp_extract_all("n", F.lit(CHUNK), F.lit(0)).alias("c")).collect():
        assert r["n"] == norm(r["text"]) == "".join(r["c"])
        assert all(len(c) >= 512 for c in r["c"][:-1]) and all(len(c) <= 4096 for c in r["c"])


def test_an_edit_changes_few_chunks(spark):
    words = " ".join(f"Word{i} goes here." for i in range(3000))
    frame = spark.createDataFrame([(words,), ("Start. " + words,)], "text string")
    a, b = (set(r["c"]) for r in frame.select(F.regexp_extract_all(without_white(F.col("text")), F.lit(CHUNK), F.lit(0)).alias("c")).collect())
    assert len(a & b) > 0.8 * len(a)


def test_one_of_each_group_stays(docs, rows, nothing):
    stay = keep_one(docs)
    assert stay.columns == docs.columns
    found = stay.collect()
    assert len(found) == len({norm(t) for _, t, *_ in rows})
    assert len({norm(r["text"]) for r in found}) == len(found)
    assert find_copies(nothing).collect() == [] and keep_one(nothing).collect() == []
