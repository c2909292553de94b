"""Weak labels, looked-up labels and analyst labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators.parse import block_id

# Words and patterns that mark a message as anomalous.
ANOMALY_WORDS = [
    "error", "fail", "exception", "timeout",
    "corrupt", "invalid", "denied",
    "unreachable", "crash", "fatal",
]
ANOMALY_PATTERNS = ["checksum", "disk", "overflow", "not found"]
ALARM_LEVELS = ["ERROR", "CRITICAL"]
ALARM_WORDS = "error|fail|refused"


def keyword_label(message: Column) -> Column:
    return F.lower(message).rlike("|".join([*ANOMALY_WORDS, *ANOMALY_PATTERNS])).cast("int")


def level_label(level: Column, ip: Column) -> Column:
    return (F.coalesce(level.isin(*ALARM_LEVELS), F.lit(False)) | ip.isNull()).cast("int")


def alarm_word_label(message: Column) -> Column:
    return F.coalesce(message.rlike(f"(?i){ALARM_WORDS}"), F.lit(False)).cast("int")


def process_label(pid: Column, service: Column) -> Column:
    return (pid.isNull() | F.coalesce(F.lower(service).contains("sendmail"), F.lit(False))).cast("int")


def lookup_block_labels(messages: DataFrame, labels: DataFrame, order: str, message: str = "message") -> DataFrame:
    """Label by block id; the last entry of a repeated id wins, unknown ids get 0.

    Messages without a block id, often most of them, would all meet in one
    join task as NULL keys; they get scattered keys that match nothing.
    """
    last = labels.groupBy("block_id").agg(F.max_by("true_label", order).alias("true_label"))
    found = block_id(F.col(message))
    scattered = F.concat(F.lit("none-"), (F.pmod(F.xxhash64(F.col(message)), F.lit(4096))).cast("string"))
    keyed = messages.withColumn("block_id", found).withColumn("_join", F.coalesce(found, scattered))
    return (
        keyed.join(last.withColumnRenamed("block_id", "_join"), "_join", "left")
        .withColumn("true_label", F.coalesce("true_label", F.lit(0)))
        .drop("_join")
    )


def analyst_label(action: Column) -> Column:
    """A false positive is 0, every other action 1."""
    return F.when(action == "false_positive", 0).otherwise(1)


def suggested_label(prob: Column) -> Column:
    """1 from 0.8, 0 up to 0.3, else none; on the probability as displayed."""
    shown = F.round(prob, 3)
    return F.when(shown >= 0.8, 1).when(shown <= 0.3, 0)


def agreement(label: Column, suggested: Column) -> Column:
    return F.when(suggested.isin(0, 1), label == suggested)


def feedback_log(events: DataFrame) -> DataFrame:
    """Add label, suggested_label and agreement to analyst actions."""
    return (
        events.withColumn("label", analyst_label(F.col("action")))
        .withColumn("suggested_label", suggested_label(F.col("prob_anomaly")))
        .withColumn("agreement", agreement(F.col("label"), F.col("suggested_label")))
    )


def feedback_training_set(events: DataFrame, message: str = "message") -> DataFrame:
    """Closed cases are 1, false positives 0; other actions and empty messages go."""
    label = F.when(F.col("action") == "closed", 1).when(F.col("action") == "false_positive", 0)
    body = text.strip(text.text_or_empty(F.col(message)))
    return (
        events.withColumn("message", body).withColumn("true_label", label)
        .where(F.col("true_label").isNotNull() & (F.col("message") != ""))
    )


def agreement_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return log.groupBy(*(by or [])).agg(
        F.count("agreement").alias("rated"),
        F.count_if(F.col("agreement")).alias("agreed"),
        F.round(F.try_divide(F.count_if(F.col("agreement")), F.count("agreement")), 6).alias("agreement_rate"),
    )
