"""Scratch tables in the shared folder, and numbering of rows without one big sort."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def write_scratch(df: DataFrame, label: str) -> str:
    """Write a table below the shared folder, so that no executor's loss undoes it; returns its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    return df.sparkSession.read.parquet(write_scratch(df, label))


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete finished scratch tables and let Spark's cleaner drop the shuffles behind them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    gc.collect()
    jvm.System.gc()


def text_keys() -> list[Column]:
    """crc and hash of the text: with the doc_id, they name a row and its equals."""
    text = F.coalesce("text", F.lit(""))
    return [F.crc32(text).alias("crc"), F.xxhash64(text).alias("hash")]


def matching(docs: DataFrame, stay: DataFrame, once: bool) -> DataFrame:
    """The rows of ``docs``, all columns as they are, named by (doc_id, crc, hash) in ``stay``; if ``once``, one of equals."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), *text_keys())
    keyed = keyed.withColumnsRenamed({"crc": "_crc", "hash": "_hash"})
    same = [F.col("_id").eqNullSafe(F.col("doc_id")), F.col("_crc") == F.col("crc"), F.col("_hash") == F.col("hash")]
    met = keyed.join(stay.select("doc_id", "crc", "hash"), same, "left_semi")
    if once:
        keys = ["_id", "_crc", "_hash"]
        met = met.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*keys))).where("_n = 1")
    return met.select("_row.*")


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row a document; 0 wins where rows disagree, rows without either are left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("_labelled")).agg(F.min(column).cast("int").alias("_label"))


def numbered(df: DataFrame, parts: list[str], order: list[Column], weight: Column, rows_each: int = 1_000_000) -> DataFrame:
    """Add ``before``: the total weight of the rows ahead of each row within ``parts``.

    The order is by hash bucket first, then ``order``. Buckets are totalled on
    their own and only the bucket totals, one row for about ``rows_each`` rows,
    are accumulated, so that a hot part is spread over as many tasks as it
    fills buckets. Rows equal in ``order`` share a bucket: count repeated rows first.
    """
    n_rows = df.count()
    buckets = max(64, -(-n_rows // rows_each))
    tagged = df.withColumn("_weight", weight).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*parts, "_bucket"]
    earlier = W.partitionBy(*[F.col(p) for p in parts]).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = tagged.groupBy(*keys).agg(F.sum("_weight").alias("_total")).withColumn(
        "_ahead", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = W.partitionBy(*[F.col(k) for k in keys]).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = tagged.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    right = ahead.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_ahead")
    met = within.join(right, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return met.select(*df.columns, (F.col("_ahead") + F.col("_inside")).cast("long").alias("before"))
