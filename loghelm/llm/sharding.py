"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1, the permutation moves number i to place p, and
p modulo the number of shards is the shard, p div that number the slot. The
permuted domain is a grid of two sides whose product exceeds n by little; places
at or beyond n walk on along their cycle, at most as many steps as the grid
exceeds n, so the walk is bounded and exact. Rounds run backwards give the row
number of a shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.llm.common import numbered

ROUNDS = 6


def sides(n: Column) -> Column:
    """Two sides of a grid, near the square root of n, whose product is at least n and exceeds it least."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    reach = F.least(F.floor(root / 4).cast("long") + 1, F.lit(500))
    options = F.transform(F.sequence(F.greatest(root - reach, F.lit(2)), root + reach + 1), lambda a: F.struct(
        (a * F.ceil(n / a) - n).cast("long").alias("excess"), a.cast("long").alias("a"), F.ceil(n / a).cast("long").alias("b")))
    return F.array_min(options)


def permuted(row: Column, n: Column, grid: Column, seed: Column, inverse: bool = False) -> Column:
    """The place of a number below n in a permutation of 0 to n - 1; ``inverse`` gives the number of a place.

    ``grid`` comes from ``sides(n)``; compute it once for each n, not for each row.
    """
    a, b = grid["a"], grid["b"]

    def step(s: Column, i: Column) -> Column:
        left, right = s["left"], s["right"]
        on_left, on_right = F.pmod(F.xxhash64(right, i, seed), a), F.pmod(F.xxhash64(left, i, seed), b)
        if inverse:
            on_left, on_right = a - on_left, b - on_right
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(left + on_left, a)).otherwise(left).alias("left"),
            F.when(even, right).otherwise(F.pmod(right + on_right, b)).alias("right"))

    def once(x: Column) -> Column:
        begin = F.struct(F.floor(x / b).cast("long").alias("left"), F.pmod(x, b).alias("right"))
        order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        return F.aggregate(F.array(*[F.lit(k) for k in order]), begin, step, lambda s: s["left"] * b + s["right"])

    walk = F.when(grid["excess"] > 0, F.sequence(F.lit(1).cast("long"), grid["excess"])).otherwise(F.array().cast("array<long>"))
    return F.aggregate(walk, once(row.cast("long")), lambda p, _: F.when(p < n, p).otherwise(once(p)))


def grid_of(spark: SparkSession, n: int) -> Column:
    """``sides`` of a known number, as literals."""
    best = spark.range(1).select(sides(F.lit(max(n, 1)).cast("long")).alias("s")).first()["s"]
    return F.struct(*[F.lit(int(best[f])).cast("long").alias(f) for f in ("excess", "a", "b")])


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, size, text_crc32, law, shard,
    slot, grown_shard, row_number.

    The law is ``rows``: shard sizes are at most one apart. Size is the text's UTF-8 bytes plus 8. Rows
    are numbered by hash bucket of (doc_id, size, text_crc32), then by these; equal rows are counted
    first, get numbers one after another, and are dealt anew. A null text has 8 bytes and checksum 0; null
    doc_ids are rows like others. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = numbered(rows.groupBy(*keys).agg(F.count("*").alias("copies")), [], [F.col(k) for k in keys], F.col("copies"))
    n = docs.count()
    block = 1 << 16
    blocks = counted.withColumn("_block", F.explode(F.expr(f"sequence(0L, copies - 1, {block}L)")))
    each = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block, least(_block + {block - 1}, copies - 1))")))
    placed = each.withColumn("row_number", F.col("before") + F.col("_copy")).withColumn(
        "_place", permuted(F.col("row_number"), F.lit(n).cast("long"), grid_of(docs.sparkSession, n), F.lit(seed)))
    return placed.select(
        *keys, F.lit("rows").alias("law"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


def row_at(spark: SparkSession, shard: Column, slot: Column, n: int, shards: int = 24, seed: int = 17) -> Column:
    """The global row number at a shard's slot."""
    return permuted(slot * shards + shard, F.lit(n).cast("long"), grid_of(spark, n), F.lit(seed), inverse=True)
