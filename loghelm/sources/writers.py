"""Sinks. Tables only grow or get a new version; nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.operators.dedup import first_timed_records
from loghelm.operators.normalize import fill_canonical


def append_anomalies(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append canonical records, one directory per day of detection.

    A day goes to as many writers, by content, as its rows fill files: few files
    for a quiet day, and no single task for a busy one. The days' counts, one row
    a day, are joined to the records.
    """
    out = fill_canonical(df).withColumn("detected_date", F.to_date("detected_at"))
    days = out.groupBy("detected_date").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    counted = out.join(days.withColumnRenamed("detected_date", "_day"), F.col("detected_date").eqNullSafe(F.col("_day")))
    writer = F.pmod(F.xxhash64("host", "message", "detected_at"), F.col("_files"))
    counted.repartition("detected_date", writer).drop("_day", "_files").write.mode("append").partitionBy("detected_date").parquet(path)


def batch_sink(path: str):
    """foreachBatch writer; a batch that is retried replaces its own directory."""

    def write(df: DataFrame, batch_id: int) -> None:
        fill_canonical(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a table version; readers move on when the pointer names it."""
    target = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def point_to(spark: SparkSession, root: str, version: str, at: Column) -> None:
    row = spark.range(1).select(F.lit(version).alias("version"), at.alias("set_at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """Table version the pointer named last."""
    row = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", "set_at").alias("version")).first()
    return spark.read.parquet(f"{root}/v={row['version']}")


def replace_deduplicated(spark: SparkSession, root: str, version: str, at: Column, order: list[str]) -> DataFrame:
    """New version without duplicates; the old version stays where it was."""
    write_version(first_timed_records(current_version(spark, root), order).drop("row_key"), root, version)
    point_to(spark, root, version, at)
    return current_version(spark, root)


def export_csv(df: DataFrame, path: str) -> None:
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", "").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def register_dataset(df: DataFrame, name: Column, added_at: Column, catalogue: str) -> None:
    """One catalogue row per data set: name, rows, added_at."""
    df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows")).withColumn("added_at", added_at).write.mode(
        "append").parquet(catalogue)


def append_actions(df: DataFrame, path: str) -> None:
    df.select("anomaly_id", "status", "comment", "action_time").write.mode("append").parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
