"""Duplicate removal.

Keys are aggregated in map-side partial results first, so a key that holds a
third of the table costs one row per task in that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text

KEY_LENGTH = 16


def row_key(host: Column, service: Column, pid: Column, message: Column) -> Column:
    """Full digest of a record's identity; a pid of 0 counts as none."""
    parts = [text.strip(F.coalesce(c, F.lit(""))) for c in (host, service)]
    pid_text = F.coalesce(F.nullif(pid.cast("string"), F.lit("0")), F.lit(""))
    return F.sha2(F.concat_ws("|", *parts, pid_text, text.strip(F.coalesce(message, F.lit("")))), 256)


def timed_key(seen: Column, host: Column, service: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[text.strip(F.coalesce(c, F.lit(""))) for c in (seen, host, service, message)]), 256)


def keep_first(df: DataFrame, key: Column, order: list[str], key_name: str = "row_key") -> DataFrame:
    """First row per key by ``order``, which has to tell rows of one key apart.

    Rows are compared on the whole digest; the stored short key is its prefix,
    too short to tell rows apart at trillions of them. Only digest and order are
    aggregated; whole rows move once, to meet the winners.
    """
    keyed = df.withColumn("_key", F.unhex(key))
    least = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    winners = keyed.groupBy("_key").agg(least.alias("_least")).withColumnRenamed("_key", "_won")
    firsts = keyed.join(winners, (F.col("_key") == F.col("_won")) & place.eqNullSafe(F.col("_least")), "left_semi")
    return firsts.withColumn(key_name, F.substring(F.lower(F.hex("_key")), 1, KEY_LENGTH)).drop("_key")


def first_records(df: DataFrame, order: list[str]) -> DataFrame:
    key = row_key(F.col("host"), F.col("service"), F.col("pid"), F.col("message"))
    return keep_first(df, key, order)


def first_timed_records(df: DataFrame, order: list[str]) -> DataFrame:
    seen = F.coalesce(text.iso(F.col("detected_at")), text.iso(F.col("timestamp")))
    return keep_first(df, timed_key(seen, F.col("host"), F.col("service"), F.col("message")), order)


def duplicate_counts(df: DataFrame) -> DataFrame:
    """rows, distinct rows and exact duplicates beyond the first."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _feedback_by_message(feedback: DataFrame, seq: str) -> DataFrame:
    """Equal rows count where they first stood; of a message's labels the last stands."""
    pairs = feedback.groupBy("message", "true_label").agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_at"))
    return pairs.groupBy("message").agg(
        F.max_by("true_label", "_at").alias("true_label"), F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_pairs"))


def resolve_feedback(feedback: DataFrame, seq: str) -> DataFrame:
    """One label per message; a message whose last label is not 0 or 1 goes."""
    return _feedback_by_message(feedback, seq).where(F.col("true_label").isin(0, 1)).select("message", "true_label")


def feedback_report(feedback: DataFrame, seq: str) -> DataFrame:
    valid = F.col("true_label").isin(0, 1)
    return _feedback_by_message(feedback, seq).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_pairs") - 1), F.lit(0)).alias("conflicts_resolved"),
        F.count_if(valid).alias("final_rows"),
        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count_if(valid)).alias("removed_rows"),
    )
