"""Decision: scores and correlation to anomaly records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import scoring, text
from loghelm.operators import clean
from loghelm.operators.correlate import ESCALATED, NOT_ESCALATED, SSH_BRUTEFORCE, CorrelationRule, correlate
from loghelm.operators.parse import canonical_service

# Lengths of the message in an alert and in a notice, applied on request.
ALERT_LENGTH = 200
NOTICE_LENGTH = 140


def _shown(message: Column, length: int | None) -> Column:
    return F.substring(message, 1, length) if length else message


def escalate(df: DataFrame, rule: CorrelationRule | list[CorrelationRule] = SSH_BRUTEFORCE, scale: str = "live",
             strict_reference: bool = False) -> DataFrame:
    """Severity, threshold, forced decision, reason and threat score of correlated rows.

    With a table of rules, each row is judged by the rule that its column ``rule`` names.
    """
    hot = F.col("correlation_triggered")
    own = scoring.severity(F.col("prob_anomaly"), scale)
    table = rule if isinstance(rule, list) else [rule]
    for r in table:
        here = hot & (F.col("rule") == r.name) if isinstance(rule, list) else hot
        own = F.when(here & (F.col("active_event_count") >= r.critical_count), "CRITICAL").when(here, r.severity).otherwise(own)
    cut = scoring.service_threshold(canonical_service(F.coalesce(F.col("service"), F.lit(""))), strict_reference)
    return (
        df.withColumn("severity", own)
        .withColumn("threshold", cut)
        .withColumn("is_anomaly_pred", (hot | (F.col("prob_anomaly") >= F.col("threshold"))).cast("int"))
        .withColumn("escalation_reason", F.when(hot, ESCALATED).otherwise(NOT_ESCALATED))
        .withColumn("threat_score", scoring.threat_score(F.col("severity")))
    )


def detect(logs: DataFrame, rule: CorrelationRule = SSH_BRUTEFORCE, id_col: str = "event_id",
           ts_col: str = "timestamp", model: str = "loghelm", source: str = "live",
           strict_reference: bool = False) -> DataFrame:
    """Anomaly records of scored logs (message, service, prob_anomaly, ...).

    detected_at is the event time, so a replay gives the same records.
    """
    usable = logs.where(clean.has_text(F.col("message")))
    judged = escalate(correlate(usable, rule, id_col, ts_col), rule, strict_reference=strict_reference)
    return judged.where("is_anomaly_pred = 1").select(
        F.col(id_col),
        F.col(ts_col).alias("timestamp"), F.col(ts_col).alias("detected_at"),
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("service", F.lit("")).alias("service"),
        F.col("message"), F.col("prob_anomaly"), F.col("is_anomaly_pred"),
        F.coalesce(F.col("pid").cast("int"), F.lit(-1)).alias("pid"),
        F.lit(model).alias("model"),
        (F.col("source") if "source" in logs.columns else F.lit(source)).alias("source"),
        "severity", F.coalesce("matched_rule", F.lit("")).alias("matched_rule"),
        "active_event_count", "correlation_triggered", "escalation_reason", "threat_score",
    )


def judge_json(events: DataFrame) -> DataFrame:
    """Decision and severity of JSON events, which bring their own probability and one threshold for all services."""
    return events.withColumns({
        "is_anomaly_pred": (F.col("prob_anomaly") >= scoring.JSON_THRESHOLD).cast("int"),
        "severity": scoring.severity(F.col("prob_anomaly"), "tail")})


def alert_lines(anomalies: DataFrame, length: int | None = None) -> DataFrame:
    line = F.format_string(
        "[ALERT] Anomaly detected: time=%s host=%s service=%s prob=%.3f severity=%s\n  msg: %s",
        text.iso(F.col("detected_at")), F.coalesce("host", F.lit("")), F.coalesce("service", F.lit("")),
        F.coalesce("prob_anomaly", F.lit(0.0)), F.coalesce("severity", F.lit("")),
        _shown(F.coalesce("message", F.lit("")), length))
    return anomalies.withColumn("alert", line)


def new_anomaly_notice(anomalies: DataFrame, notified: DataFrame, key: str, since: Column, length: int | None = None) -> DataFrame:
    """One row: how many unseen anomalies after ``since``, a sample, the highest severity.

    ``notified`` holds the keys already announced. The sample is the first row
    in display order: highest severity, then newest.
    """
    rank = scoring.severity_rank(F.col("severity"))
    fresh = anomalies.where(F.col("detected_at") > since).join(notified.select(key), key, "left_anti")
    order = F.struct(rank, F.col("detected_at"), F.col(key))
    sample = F.concat(F.coalesce("service", F.lit("system")), F.lit(": "), _shown(F.col("message"), length))
    top = F.max(rank)
    return fresh.agg(
        F.count(F.lit(1)).alias("new_anomalies"),
        F.max_by(sample, order).alias("sample"),
        F.when(top == 3, "HIGH").when(top == 2, "MEDIUM").otherwise("LOW").alias("highest_severity"),
    )
