"""Train/test split, folds and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.operators.ranking import hash_bucket, running_totals

SMALL, MEDIUM = 20, 100


def seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def _ranked(df: DataFrame, parts: list[str], id_col: str, seed: int, rows: int) -> DataFrame:
    """1-based place of each row in seeded order within its part, and the part's size."""
    hashed = df.withColumn("_h", seeded(id_col, seed))
    return running_totals(hashed, parts, [F.col("_h"), F.col(id_col)], {"place": F.lit(1)}, hash_bucket(F.col("_h"), rows),
                          {"part_rows": "place"}).drop("_h")


def train_test(df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = 42,
               small_data: bool = False) -> DataFrame:
    """Add is_train and is_test: each class gives its share, rounded up, to the test side.

    ``small_data`` asks for the rules of small tables: below 20 rows every row
    is both, below 100 the split ignores labels.
    """
    n = df.count()
    if small_data and n < SMALL:
        return df.withColumn("is_train", F.lit(True)).withColumn("is_test", F.lit(True))
    ranked = _ranked(df, [] if small_data and n < MEDIUM else [label], id_col, seed, n)
    test = F.col("place") <= F.ceil(F.lit(test_size) * F.col("part_rows"))
    return ranked.withColumn("is_test", test).withColumn("is_train", ~test).drop("place", "part_rows")


def bounded(df: DataFrame, id_col: str, rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows, the first in seeded order: a documented bound on the labelled rows a fit reads."""
    return df.orderBy(seeded(id_col, seed), id_col).limit(rows)


def fold_count(df: DataFrame, label: str, requested: int = 5) -> int:
    """Requested folds, fewer when the rarest class is smaller, never below two."""
    rare = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first()["m"] or 0
    return requested if rare >= requested else max(2, rare)


def folds(df: DataFrame, label: str, id_col: str, requested: int = 5, seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in seeded order."""
    k = fold_count(df, label, requested)
    ranked = _ranked(df, [*(within or []), label], id_col, seed, df.count())
    return ranked.withColumn("fold", ((F.col("place") - 1) % k).cast("int")).drop("place", "part_rows")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight n / (classes * rows of the class)."""
    from pyspark.sql import Window as W
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    return counts.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights as a column: one count per class, then a CASE, no join."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) > 100:
        raise ValueError(f"{label} does not look like a class label: {len(counts)} values")
    total = sum(counts.values())
    out = F.lit(1.0)
    for value, n in counts.items():
        out = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(out)
    return df.withColumn(name, out)
