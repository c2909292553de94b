"""Structured Streaming forms of the live path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loghelm.functions import text
from loghelm.operators import clean
from loghelm.operators.correlate import SSH_BRUTEFORCE, CorrelationRule, first_rule, matched_pattern, micros
from loghelm.operators.dedup import row_key
from loghelm.operators.detect import escalate
from loghelm.operators.ml.retrain import DeployedScorer
from loghelm.operators.parse import parse_syslog, source_ip
from loghelm.session import state_store
from loghelm.sources.writers import batch_sink
from loghelm.streaming.correlation import counted_events


def tail_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of a log directory; the checkpoint remembers what was read."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)


def new_rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Rows of files added since the last run."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def parsed_tail(spark: SparkSession, path: str, reference_time: Column) -> DataFrame:
    return parse_syslog(tail_lines(spark, path), reference_time)


def run_available(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is, then stop; a second run continues after it."""
    with state_store(df.sparkSession):
        query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
            availableNow=True).start()
    query.awaitTermination()


def run_every(df: DataFrame, sink, checkpoint: str, seconds: float, mode: str = "append") -> StreamingQuery:
    """A job that goes on, one batch every ``seconds`` at most; stop the query it returns."""
    with state_store(df.sparkSession):
        return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
            processingTime=f"{seconds} seconds").start()


def scoring_sink(root: str, path: str):
    """Writer that scores each batch with the model version deployed when the batch starts.

    A version promoted while the job runs is picked up by the next batch; a retried batch replaces its own directory.
    """
    scorer, write = DeployedScorer(root), plain_sink(path)
    return lambda df, batch_id: write(scorer.score(df), batch_id)


def plain_sink(path: str):
    """Writer for any schema; a retried batch replaces its own directory."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def first_records(df: DataFrame, delay: str, ts_col: str = "timestamp") -> DataFrame:
    """Drop repeats of a record within the watermark delay; state older than it is freed."""
    key = row_key(F.col("host"), F.col("service"), F.col("pid"), F.col("message"))
    timed = df.withColumn("event_time", F.col(ts_col).cast("timestamp")).withColumn("row_key", key)
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["row_key"]).drop("event_time")


def correlate_stream(logs: DataFrame, rules: CorrelationRule | list[CorrelationRule] = SSH_BRUTEFORCE, delay: str = "10 minutes",
                     id_col: str = "event_id", ts_col: str = "timestamp") -> DataFrame:
    """Streaming twin of ``correlate`` and ``correlate_rules``: event time, late rows beyond ``delay`` dropped.

    An event belongs to the first rule it matches, named in ``rule``. Rows that match none pass on at once.
    """
    rules = rules if isinstance(rules, list) else [rules]
    message = F.lower(text.strip(F.coalesce(F.col("message"), F.lit(""))))
    timed = logs.withColumn("event_time", F.col(ts_col).cast("timestamp")).withWatermark("event_time", delay)
    tagged = timed.withColumns({
        "src_ip": source_ip(message), "rule": first_rule(message, rules),
        "matched_rule": F.coalesce(*[matched_pattern(message, r) for r in rules])})
    # Naming the event time keeps these tests above the watermark node, so every
    # row moves the watermark and a quiet rule cannot hold it back.
    hit = F.when(F.col("event_time").isNotNull(), F.col("rule"))
    payload_cols = [*logs.columns, "src_ip", "matched_rule"]
    schema = T.StructType([f for f in tagged.schema.fields if f.name in payload_cols])
    narrow = tagged.where(hit.isNotNull()).select(
        "rule", F.col("src_ip").alias("ip"), F.col("event_time"),
        F.md5(F.concat_ws(":", "src_ip", message)).alias("sig"), micros(F.col(ts_col)).alias("us"),
        F.col(id_col).cast("long").alias("id"),
        F.to_json(F.struct(*payload_cols), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("payload"))
    seen = counted_events(narrow, rules).select(
        F.from_json("payload", schema, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("p"), "rule", "active_event_count"
    ).select("p.*", "rule", "active_event_count")
    rest = tagged.where(hit.isNull()).drop("event_time").withColumn("active_event_count", F.lit(0).cast("long"))
    threshold = F.coalesce(*[F.when(F.col("rule") == r.name, r.correlation_threshold) for r in rules])
    return rest.unionByName(seen).withColumn(
        "correlation_triggered", F.coalesce(F.col("active_event_count") >= threshold, F.lit(False)))


def live_job(logs: DataFrame, out: str, checkpoint: str, rule: CorrelationRule | list[CorrelationRule] = SSH_BRUTEFORCE,
             delay: str = "10 minutes", ts_col: str = "timestamp") -> None:
    """Scored log stream to the canonical anomaly table."""
    usable = logs.where(clean.has_text(F.col("message")))
    judged = escalate(correlate_stream(usable, rule, delay, ts_col=ts_col), rule).where("is_anomaly_pred = 1")
    records = judged.withColumn("detected_at", F.col(ts_col)).withColumn("model", F.lit("loghelm")).withColumn(
        "matched_rule", F.coalesce("matched_rule", F.lit("")))
    run_available(records, batch_sink(out), checkpoint)
