"""Streaming and storage queries: the given tables pass through files, then come back."""

from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import detect
from loghelm.operators.query import latest_actions
from loghelm.plans import detect_plans as dp
from loghelm.plans import sqltext as q
from loghelm.plans.parse_plans import _FIELDS, _TIME
from loghelm.plans.query_plans import _LAST
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views
from loghelm.session import scratch_path
from loghelm.sources import readers, writers
from loghelm.streaming import jobs

def _staged(df, path, ts="timestamp"):
    """Write a table as four arrivals in time order, cut at the quartiles; rows without a time come first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01) or [0.0]
    arrival = sum(((at > F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
    for part in range(len(cuts) + 1):
        df.where(F.coalesce(arrival, F.lit(0)) == part).write.mode("append").parquet(path)


@query("stream_parse_tail", with_views("v_syslog") + _FIELDS + _TIME + """
SELECT strftime(coalesce(CASE WHEN y0 > TIMESTAMP '2024-01-20 12:00:00' THEN y1 ELSE y0 END, TIMESTAMP '2024-01-20 12:00:00'),
  '%Y-%m-%dT%H:%M:%SZ') AS timestamp, host, service, coalesce(TRY_CAST(nullif(pid, '') AS INT), -1) AS pid, message FROM timed""")
def stream_parse_tail(spark, sf):
    """Two runs over a growing log directory; the second reads only the new files."""
    src, out, state = (scratch_path(spark, n) for n in ("tail", "parsed", "checkpoint"))
    lines = table(spark, sf, "v_syslog")
    ref = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    for part in ("value < 'Jan 15'", "NOT (value < 'Jan 15')"):
        lines.where(part).select("value").write.mode("append").text(src)
        jobs.run_available(jobs.parsed_tail(spark, src, ref), jobs.plain_sink(f"{out}/{len(part)}"), state)
    parsed = spark.read.option("recursiveFileLookup", True).parquet(out)
    return parsed.withColumn("timestamp", text.iso(F.col("timestamp")))


@query("stream_first_records", with_views("v_logs") + """SELECT DISTINCT sha256(trim(host) || '|' || trim(service) || '|'
 || CASE WHEN pid = 0 THEN '' ELSE CAST(pid AS VARCHAR) END || '|' || trim(message)) AS row_key FROM v_logs""")
def stream_first_records(spark, sf):
    src, out, state = (scratch_path(spark, n) for n in ("logs", "firsts", "checkpoint"))
    logs = table(spark, sf, "v_logs").select("event_id", "timestamp", "host", "service", "pid", "message")
    _staged(logs, src)
    stream = jobs.new_rows(spark, src, logs.schema)
    jobs.run_available(jobs.first_records(stream, "400 days"), jobs.plain_sink(out), state)
    return spark.read.parquet(out).select("row_key")


_STREAM_COLS = ["timestamp", "host", "service", "message", "prob_anomaly", "is_anomaly_pred", "pid", "source", "severity",
                "matched_rule", "active_event_count", "correlation_triggered", "escalation_reason", "threat_score"]


def _with_end(spark, logs, src):
    """Write the logs as arrivals, then a far later row that moves the watermark past the last event."""
    _staged(logs, src)
    end = logs.agg((F.max("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("end")).first()["end"]
    last = logs.limit(1).withColumn("timestamp", F.lit(end)).withColumn(
        "message", F.lit("end")).withColumn("prob_anomaly", F.lit(0.0))
    last.write.mode("append").parquet(src)


@query("stream_rule_table", dp.RULES_RECORDS_SQL + "SELECT " + ", ".join(["event_id", "rule", *_STREAM_COLS[4:5], "severity", "matched_rule",
       "active_event_count", "correlation_triggered", "threat_score"]) + " FROM records")
def stream_rule_table(spark, sf):
    """Live detection by a table of two rules as a stream."""
    src, out, state = (scratch_path(spark, n) for n in ("logs", "anomalies", "checkpoint"))
    logs = table(spark, sf, "v_logs").select("event_id", "timestamp", "host", "service", "message", "prob_anomaly", "pid", "source")
    _with_end(spark, logs, src)
    stream = jobs.correlate_stream(jobs.new_rows(spark, src, logs.schema), dp.RULES, "1 hour")
    judged = detect.escalate(stream, dp.RULES).where("is_anomaly_pred = 1").select(
        "event_id", "rule", "prob_anomaly", "severity", F.coalesce("matched_rule", F.lit("")).alias("matched_rule"),
        "active_event_count", "correlation_triggered", "threat_score")
    jobs.run_available(judged, jobs.plain_sink(out), state)
    return spark.read.parquet(out).drop("batch")


@query("stream_detection", dp.RECORDS_SQL + "SELECT " + ", ".join(_STREAM_COLS) + " FROM records")
def stream_detection(spark, sf):
    """Live detection as a stream."""
    src, out, state = (scratch_path(spark, n) for n in ("logs", "anomalies", "checkpoint"))
    logs = table(spark, sf, "v_logs").select("event_id", "timestamp", "host", "service", "message", "prob_anomaly", "pid", "source")
    _with_end(spark, logs, src)
    jobs.live_job(jobs.new_rows(spark, src, logs.schema), out, state, dp.WIDE_RULE, "1 hour")
    return spark.read.parquet(out).select(*_STREAM_COLS).withColumn("timestamp", text.iso(F.col("timestamp")))


_LIST = "event_id, host, service, message, prob_anomaly"


@query("csv_round_trip", with_views("v_logs") + "SELECT event_id, host, service, CASE WHEN k < 10 THEN '' ELSE message || ', \"' || host || '\"' END AS message FROM v_logs")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "v_logs").select("event_id", "host", "service", F.expr(
        "CASE WHEN k < 10 THEN '' ELSE concat(message, ', \"', host, '\"') END").alias("message"))
    writers.export_csv(rows, path)
    return readers.csv_strings(spark, path).withColumn("event_id", F.col("event_id").cast("long"))


@query("typed_csv_scan", with_views("v_logs") + "SELECT event_id, prob_anomaly, pid FROM v_logs WHERE prob_anomaly >= 0.5")
def typed_csv_scan(spark, sf):
    path = scratch_path(spark, "typed")
    broken = F.expr("CASE WHEN k % 3 = 0 THEN concat(message, '\n\"', host, '\"\r\n,1,2') ELSE message END").alias("message")
    rows = table(spark, sf, "v_logs").select("event_id", broken, "prob_anomaly", "pid")
    rows.write.options(header=True, escape='"').csv(path)
    return readers.csv_typed(spark, path, rows.schema).where("prob_anomaly >= 0.5").drop("message")


@query("json_export", with_views("v_logs") + f"SELECT {_LIST} FROM v_logs")
def json_export(spark, sf):
    path = scratch_path(spark, "json")
    rows = table(spark, sf, "v_logs").select("event_id", "host", "service", "message", "prob_anomaly")
    writers.export_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("last_lines", with_views("v_syslog") + "SELECT event_id, value FROM v_syslog WHERE trim(value) <> '' ORDER BY event_id DESC LIMIT 20")
def last_lines(spark, sf):
    return readers.last_lines(table(spark, sf, "v_syslog"), "event_id", 20)


@query("training_load", with_views("v_logs") + "SELECT event_id, message, CAST(event_type = 'error' AS INT) AS label FROM v_logs")
def training_load(spark, sf):
    rows = table(spark, sf, "v_logs").select("event_id", "message", F.expr("CAST(event_type = 'error' AS STRING)").alias("b"))
    return readers.labelled(rows.withColumn("is_anomaly", (F.col("b") == "true").cast("int"))).select("event_id", "message", "label")


@query("appended_anomalies", dp.RECORDS_SQL + """SELECT substr(detected_at, 1, 10) AS detected_date, severity, count(*) AS anomalies FROM records
 WHERE detected_at >= '2024-01-05' AND detected_at < '2024-01-13' GROUP BY 1, 2""")
def appended_anomalies(spark, sf):
    """Append records by day, then read a span of days; other days are not opened."""
    path = scratch_path(spark, "anomalies")
    writers.append_anomalies(dp.records(spark, sf), path)
    span = readers.parquet_between(spark, path, F.lit("2024-01-05"), F.lit("2024-01-12"))
    return span.groupBy(F.date_format("detected_date", "yyyy-MM-dd").alias("detected_date"), "severity").agg(F.count(F.lit(1)).alias("anomalies"))


@query("replaced_deduplicated", with_views("v_logs") + """, t AS (SELECT strftime(date_trunc('day', detected_at), '%Y-%m-%dT%H:%M:%SZ') AS seen, host, service, message, min(event_id) AS event_id FROM v_logs GROUP BY 1, 2, 3, 4)
SELECT event_id, seen FROM t""")
def replaced_deduplicated(spark, sf):
    root = scratch_path(spark, "versions")
    rows = table(spark, sf, "v_logs").select("event_id", F.date_trunc("day", "detected_at").cast("timestamp_ntz").alias("detected_at"),
                                             "timestamp", "host", "service", "message")
    writers.write_version(rows, root, "1")
    writers.point_to(spark, root, "1", F.lit("2024-02-01"))
    out = writers.replace_deduplicated(spark, root, "2", F.lit("2024-02-02"), ["event_id"])
    return out.select("event_id", text.iso(F.col("detected_at")).alias("seen"))


@query("upload_catalogue", "SELECT source AS name, count(*) AS rows, '20240201T000000Z' AS added_at FROM documents GROUP BY 1")
def upload_catalogue(spark, sf):
    path = scratch_path(spark, "catalogue")
    writers.register_dataset(table(spark, sf, "documents"), F.col("source"), F.lit("20240201T000000Z"), path)
    return spark.read.parquet(path)


@query("upserted_actions", with_views("v_actions") + _LAST + f"SELECT anomaly_id, status, comment, {q.iso('action_time')} AS action_time FROM lasts")
def upserted_actions(spark, sf):
    """Actions are appended as they come; the last one per anomaly is read back."""
    path = scratch_path(spark, "actions")
    actions = table(spark, sf, "v_actions")
    writers.append_actions(actions.where("comment = 'first look'"), path)
    writers.append_actions(actions.where("comment <> 'first look'"), path)
    return latest_actions(spark.read.parquet(path)).withColumn("action_time", text.iso(F.col("action_time")))


@query("saved_metrics", with_views("v_scored") + "SELECT model, round(avg((score - label) * (score - label)), 6) AS brier FROM v_scored GROUP BY 1")
def saved_metrics(spark, sf):
    from loghelm.operators.evaluate import brier
    path = scratch_path(spark, "metrics")
    writers.save_metrics(brier(table(spark, sf, "v_scored"), ["model"]), path)
    return spark.read.schema("model string, brier double").json(path)


@query("validation_run", with_views("v_scored") + """, c AS (SELECT count(*) FILTER (label = 0 AND score < 0.7) AS tn, count(*) FILTER (label = 0 AND score >= 0.7) AS fp,
  count(*) FILTER (label = 1 AND score < 0.7) AS fn, count(*) FILTER (label = 1 AND score >= 0.7) AS tp FROM v_scored WHERE model = 'rules')
SELECT 'rules' AS data_set, '2024-02-01T00:00:00Z' AS validated_at, CAST(0.7 AS DOUBLE) AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision_anomaly,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall_anomaly, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1_anomaly, tn, fp, fn, tp FROM c""")
def validation_run(spark, sf):
    """Score a second labelled set, save the metrics row and read it back."""
    from loghelm.operators.evaluate import validation_run as validated
    path = scratch_path(spark, "validation")
    rows = validated(table(spark, sf, "v_scored").where("model = 'rules'"), 0.7, F.lit("rules"), F.lit("2024-02-01T00:00:00Z"))
    writers.save_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)
