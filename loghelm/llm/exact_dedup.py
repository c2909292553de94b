"""Exact duplicates by recipes of content-defined chunks.

Texts are compared without white space. Each is cut at places its content
decides: after a sentence end, no chunk below 512 characters nor above 4096,
the last one excepted. A chunk is known by a 64-bit hash and its length; over
the whole corpus the chunks' SHA-256 digests verify that hash and length mean one
content, and number those contents where they don't. A text's recipe is its
ordered list of verified identifiers, and texts are equal if their recipes are.
Long texts are read where they lie: only hashes and identifiers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, matching, text_keys, write_scratch

WHITE = " \t\n\x0b\f\r"
CHUNK = r"(?s).{512,4095}?[.!?](?=\p{Lu})|.{1,4096}"


def without_white(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    norm = docs.select(
        F.col("doc_id").cast("long"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        without_white(F.col("text")).alias("norm"), *text_keys())
    chunks = F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)), lambda c: F.struct(
        F.xxhash64(c).alias("hash"), F.octet_length(c).alias("bytes"), F.unhex(F.sha2(c, 256)).alias("digest")))
    return norm.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "n_points", "crc", "hash",
        F.sha2("norm", 256).alias("text_sha256"), chunks.alias("chunks"))


def _verified(rows: DataFrame) -> DataFrame:
    """Each hash and length with the digests of its contents; one, but for collisions."""
    return rows.select(F.explode("chunks").alias("c")).groupBy("c.hash", "c.bytes").agg(
        F.array_sort(F.collect_set("c.digest")).alias("contents"))


def _recipes(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """row_no and the ordered verified identifiers of each row."""
    used = rows.select("row_no", F.posexplode("chunks").alias("pos", "c")).select("row_no", "pos", "c.*")
    named = used.join(verified, ["hash", "bytes"]).select(
        "row_no", F.struct("pos", "hash", "bytes", F.array_position("contents", F.col("digest")).alias("content")).alias("part"))
    listed = named.groupBy("row_no").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    recipe = F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), p["bytes"].alias("bytes"), p["content"].alias("content")))
    empty = F.array().cast("array<struct<hash:bigint,bytes:int,content:bigint>>")
    return rows.drop("chunks").join(listed.select("row_no", recipe.alias("recipe")), "row_no", "left").withColumn(
        "recipe", F.coalesce("recipe", empty))


def find_copies(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, keep_id, group_size, kept,
    text_sha256, n_points, and crc and hash of the original text.

    Of rows with equal texts (white space 09-0D and 20 deleted) the one with the most code points in its
    original text stays, then the smallest doc_id (null last); of rows that tie in both, exactly one.
    A null text counts as empty, and empty texts are copies of each other. No rows give no rows.
    """
    spark = docs.sparkSession
    rows_path = write_scratch(_rows(docs), "exact-chunks")
    rows = spark.read.parquet(rows_path)
    # written, so that both sides of the join are shuffled and a passage that many rows share can be split
    verified_path = write_scratch(_verified(rows), "exact-verified")
    recipes_path = write_scratch(_recipes(rows, spark.read.parquet(verified_path)), "exact-recipes")
    drop_scratch(spark, rows_path, verified_path)
    recipes = spark.read.parquet(recipes_path)
    best = F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    groups = recipes.groupBy("recipe").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups_path = write_scratch(groups, "exact-groups")  # written for the same reason: a large group's join can be split
    return recipes.join(spark.read.parquet(groups_path), "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256", "n_points", "crc", "hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    return matching(docs, find_copies(docs).where("kept"), once=True)
