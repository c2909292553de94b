"""Log-shaped views over the given tables.

Each view is one SELECT text that Spark SQL and DuckDB both accept, so a query
and its SQL twin start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loghelm.session import spread

_EVENT_PARTS = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS ip,
       CAST(event_id AS STRING) AS eid,
       CAST(user_id AS STRING) AS uid
FROM events
"""

V_LOGS = f"""
SELECT event_id, user_id, event_type, k, ip, value,
       ts AS timestamp, ts AS detected_at,
       'host-' || CAST(user_id % 7 AS STRING) AS host,
       CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'CRON'
            WHEN 'purchase' THEN 'httpd' WHEN 'click' THEN 'sendmail' ELSE 'hdfs' END AS service,
       CAST(user_id AS INT) AS pid,
       CASE
         WHEN event_type = 'error' AND k < 40 THEN 'Failed password for root from ' || ip || ' port 22 ssh2'
         WHEN event_type = 'error' AND k < 60 THEN 'authentication failed for invalid user admin from ' || ip || ' port ' || CAST(1024 + k AS STRING)
         WHEN event_type = 'error' AND k < 80 THEN 'sudo: brute force suspected from ' || ip || ' user=svc' || uid
         WHEN event_type = 'error' THEN 'segfault error in /usr/lib/app.so panic code ' || CAST(k AS STRING)
         WHEN event_type = 'signup' AND k < 50 THEN '(root) CMD (run-parts /etc/cron.hourly) scheduled pid=' || eid
         WHEN event_type = 'signup' THEN 'scheduled script backup.sh file modified uid=' || uid
         WHEN event_type = 'purchase' AND k < 70 THEN 'GET /var/www/item/' || CAST(k AS STRING) || ' timeout error'
         WHEN event_type = 'purchase' THEN 'process spawn memory exhaustion 0x' || lower(hex(event_id + 4096)) || ' cpu exception'
         WHEN event_type = 'click' AND k < 60 THEN 'connection from ' || ip || ' invalid user'
         WHEN event_type = 'click' AND k < 80 THEN 'port scan nmap recon sweep from ' || ip
         WHEN event_type = 'click' THEN 'Connection traffic normal via node-' || uid || ' mac 00:1A:2B:3C:4D:5E user=u.' || uid
         WHEN k < 50 THEN 'blk_' || eid || ' terminating node-' || uid || ' 0x' || lower(hex(event_id))
         WHEN k < 90 THEN 'blk_-' || eid || ' checksum verified 2024-01-01T10:00:00Z by ops@example.com'
         ELSE 'Received  block blk_' || eid || ' of size ' || CAST(k * 1000 AS STRING) || ' from ' || ip || ' deadbeef' || CAST(k AS STRING)
       END AS message,
       least(CAST(0.99 AS DOUBLE), round(value / 150.0, 6)) AS prob_anomaly,
       CASE WHEN event_id % 3 = 0 THEN 'upload' ELSE 'live' END AS source
FROM ({_EVENT_PARTS}) AS parts
"""

# Year-less syslog text; every tenth line is broken in one of several ways.
V_SYSLOG = f"""
SELECT event_id,
       CASE WHEN event_id % 50 = 0 THEN ''
            WHEN event_id % 50 = 10 THEN 'no header ' || message
            WHEN event_id % 50 = 20 THEN 'Feb 30 10:00:00 ' || host || ' ' || service || ': ' || message
            WHEN event_id % 50 = 30 THEN 'Xxx 12 10:00:00 ' || host || ' ' || service || ': ' || message
            WHEN event_id % 50 = 40 THEN 'Dec 31 23:59:59 ' || host || ' my ' || service || ': ' || message
            ELSE {{syslog_time}} || ' ' || host || ' ' || service
                 || CASE WHEN event_type = 'view' THEN '' ELSE '[' || CAST(pid AS STRING) || ']' END
                 || ': ' || message END AS value
FROM v_logs
"""

V_BRACKETED = """
SELECT event_id,
       '[' || {iso} || '] '
       || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL' WHEN 'click' THEN 'WARN' ELSE 'INFO' END
       || ': ' || message AS value
FROM v_logs
"""

V_UPLOAD = """
SELECT event_id,
       {iso} AS `Time`, 'host-' || CAST(user_id % 7 AS STRING) AS `HostName`, service AS `svc`, message AS `Msg`,
       CASE WHEN k < 5 THEN '' WHEN k < 10 THEN 'n/a'
            WHEN k < 40 THEN CAST(CAST(k AS DOUBLE) + 0.5 AS STRING)
            WHEN k < 45 THEN '-1.5'
            ELSE CAST(CAST(k AS DOUBLE) / 128.0 AS STRING) END AS `Score`
FROM v_logs
"""

V_CORPUS = """
SELECT event_id AS id, message, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS true_label,
       CASE WHEN event_id % 2 = 0 THEN 'hdfs' ELSE 'bgl' END AS source_dataset
FROM v_logs
UNION ALL
SELECT 1000000000000 + d.doc_id AS id, d.text AS message, l.toxic AS true_label, 'documents' AS source_dataset
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# The same texts, labelled or not, for what needs no label.
V_MESSAGES = V_CORPUS.replace("d JOIN labels", "d LEFT JOIN labels")

V_FEEDBACK = """
SELECT event_id AS seq, event_id, message, prob_anomaly,
       CASE event_type WHEN 'error' THEN 'closed' WHEN 'view' THEN 'false_positive'
            WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'escalate' ELSE 'closed' END AS action,
       CASE WHEN k < 10 THEN '   ' ELSE CASE WHEN k < 50 THEN 'shared message ' || CAST(user_id AS STRING) ELSE message END END AS fb_message,
       CASE WHEN event_type = 'view' THEN 0 WHEN k >= 95 THEN 7 ELSE 1 END AS fb_label,
       detected_at AS action_time
FROM v_logs
"""

V_ACTIONS = """
SELECT event_id AS anomaly_id, 'acknowledged' AS status, 'first look' AS comment, detected_at AS action_time
FROM v_logs WHERE event_type IN ('error', 'click')
UNION ALL
SELECT event_id AS anomaly_id,
       CASE WHEN k < 30 THEN 'closed' WHEN k < 60 THEN 'false_positive' WHEN k < 70 THEN 'bogus' ELSE 'acknowledged' END AS status,
       'second look' AS comment, detected_at + INTERVAL 1 HOUR AS action_time
FROM v_logs WHERE event_type IN ('error', 'view')
"""

V_SCORED = """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       CASE WHEN event_type = 'error' THEN least(CAST(0.99 AS DOUBLE), CAST(0.30 AS DOUBLE) + CAST(k AS DOUBLE) / 125.0)
            ELSE CAST(k AS DOUBLE) / 160.0 END AS score, 'rules' AS model
FROM v_logs
UNION ALL
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, prob_anomaly AS score, 'prob' AS model
FROM v_logs
UNION ALL
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       CAST((event_id * 7919 + k) % 1000 AS DOUBLE) / 1000.0 AS score, 'noise' AS model
FROM v_logs
"""

V_BLOCK_LABELS = """
SELECT 'blk_' || CAST(event_id AS STRING) AS `BlockId`, event_id AS seq,
       CASE WHEN k < 10 THEN 'Anomaly' WHEN k < 15 THEN 'ABNORMAL' WHEN k < 20 THEN '1' ELSE 'Normal' END AS `Label`
FROM v_logs WHERE event_type = 'view' AND k < 45
UNION ALL
SELECT 'blk_' || CAST(event_id AS STRING) AS `BlockId`, event_id + 1000000000 AS seq, 'Normal' AS `Label`
FROM v_logs WHERE event_type = 'view' AND k < 5
"""

# An anomaly table that fills every severity, source, count and rule.
V_ANOMS = """
SELECT event_id, timestamp, detected_at, host, CASE WHEN k < 5 THEN '  ' ELSE service END AS service, message, prob_anomaly,
       CASE WHEN prob_anomaly >= 0.1 THEN 1 ELSE 0 END AS is_anomaly_pred, pid, 'loghelm' AS model,
       CASE WHEN source = 'upload' AND k < 50 THEN ' Uploads' ELSE source END AS source,
       CASE WHEN k >= 85 THEN 'CRITICAL' WHEN prob_anomaly >= 0.75 THEN 'HIGH' WHEN prob_anomaly >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CAST(k % 8 AS BIGINT) AS active_event_count, (k % 8) >= 3 AND k >= 20 AS correlation_triggered,
       CASE WHEN (k % 8) >= 3 AND k >= 20 THEN 'Repeated behavioral correlation detected' WHEN k < 10 THEN '' ELSE 'ML semantic anomaly' END AS escalation_reason,
       CASE WHEN k >= 85 THEN 100 WHEN prob_anomaly >= 0.75 THEN 75 WHEN prob_anomaly >= 0.35 THEN 50 ELSE 25 END AS threat_score
FROM v_logs
"""

# One retraining run per day, measured on that day's scores.
V_HISTORY = """
SELECT {day} || '_120000' AS timestamp, count(*) AS dataset_size, count(CASE WHEN event_type = 'view' THEN 1 END) AS feedback_samples,
       CAST(0.55 AS DOUBLE) AS threshold, round(avg(prob_anomaly), 4) AS f1_score,
       CASE WHEN avg(prob_anomaly) >= 0.3 THEN 'DEPLOYED' ELSE 'FAILED' END AS deployment_status
FROM v_logs GROUP BY 1
"""

# An all-string copy of the anomaly table with the damage such files collect.
V_STORED = """
SELECT event_id,
       CASE WHEN k = 0 THEN 'timestamp' WHEN k = 1 THEN '' WHEN k = 5 THEN 'bad' ELSE {iso} END AS timestamp,
       CASE WHEN k = 0 THEN ' detected_at' WHEN k = 1 THEN '' WHEN k BETWEEN 2 AND 5 THEN 'not a date' ELSE {iso} END AS detected_at,
       CASE WHEN k = 0 THEN 'host' WHEN k IN (1, 10) THEN '' ELSE host END AS host,
       CASE WHEN k = 0 THEN 'service' WHEN k = 1 THEN '' ELSE service END AS service,
       CASE WHEN k = 0 THEN 'message' WHEN k IN (1, 10, 11) THEN '' WHEN k = 9 THEN repeat(message || '   ', 300) ELSE '  ' || message END AS message,
       CASE WHEN k = 0 THEN 'prob_anomaly' WHEN k = 1 THEN '' WHEN k = 6 THEN 'high' ELSE CAST(CAST(k AS DOUBLE) / 128.0 AS STRING) END AS prob_anomaly,
       CASE WHEN k = 0 THEN 'is_anomaly_pred' WHEN k = 1 THEN '' WHEN k < 50 THEN '1' WHEN k < 60 THEN 'x' ELSE '0' END AS is_anomaly_pred,
       CASE WHEN k = 0 THEN 'pid' WHEN k IN (1, 7) THEN '' ELSE CAST(pid AS STRING) END AS pid,
       CASE WHEN k = 0 THEN 'source' WHEN k = 1 THEN '' ELSE source END AS source,
       CASE WHEN k = 0 THEN 'severity' WHEN k = 1 THEN '' WHEN k < 20 THEN '' WHEN k < 50 THEN 'high' ELSE 'MEDIUM' END AS severity
FROM v_logs
"""

V_TEXT = """
SELECT 'documents' AS kind, doc_id AS id, text FROM documents
UNION ALL SELECT 'conversations' AS kind, conv_id * 1000 + turn AS id, text FROM conversations
UNION ALL SELECT 'pages' AS kind, page_id AS id, html AS text FROM pages
UNION ALL SELECT 'logs' AS kind, event_id AS id, message AS text FROM v_logs
"""

_NEEDS = {
    "v_logs": (V_LOGS, ["events"]),
    "v_syslog": (V_SYSLOG, ["v_logs"]),
    "v_bracketed": (V_BRACKETED, ["v_logs"]),
    "v_upload": (V_UPLOAD, ["v_logs"]),
    "v_corpus": (V_CORPUS, ["v_logs", "documents", "labels"]),
    "v_messages": (V_MESSAGES, ["v_logs", "documents", "labels"]),
    "v_feedback": (V_FEEDBACK, ["v_logs"]),
    "v_actions": (V_ACTIONS, ["v_logs"]),
    "v_scored": (V_SCORED, ["v_logs"]),
    "v_block_labels": (V_BLOCK_LABELS, ["v_logs"]),
    "v_anoms": (V_ANOMS, ["v_logs"]),
    "v_history": (V_HISTORY, ["v_logs"]),
    "v_stored": (V_STORED, ["v_logs"]),
    "v_text": (V_TEXT, ["documents", "conversations", "pages", "v_logs"]),
}

_SPARK = {
    "iso": "date_format(detected_at, 'yyyy-MM-dd HH:mm:ss')",
    "day": "date_format(detected_at, 'yyyyMMdd')",
    "syslog_time": "date_format(detected_at, 'MMM dd HH:mm:ss')",
}
_DUCK = {
    "iso": "strftime(detected_at, '%Y-%m-%d %H:%M:%S')",
    "day": "strftime(detected_at, '%Y%m%d')",
    "syslog_time": "strftime(detected_at, '%b %d %H:%M:%S')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a log-shaped view over them."""
    if name not in _NEEDS:
        return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    text, needs = _NEEDS[name]
    inputs = {need: table(spark, sf_dir, need) for need in needs}
    for need in needs:
        text = text.replace(f"FROM {need}", f"FROM {{{need}}}").replace(f"JOIN {need} ", f"JOIN {{{need}}} ")
    for key, value in _SPARK.items():
        text = text.replace("{" + key + "}", value)
    return spark.sql(text, **inputs)


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause holding the views and what they need, for the SQL twin."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in _NEEDS and name not in ordered:
            for need in _NEEDS[name][1]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        text = _NEEDS[name][0]
        for key, value in _DUCK.items():
            text = text.replace("{" + key + "}", value)
        parts.append(f"{name} AS ({text.replace('`', chr(34)).strip()})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
