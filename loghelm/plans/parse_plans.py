"""Parsing queries."""

from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import parse
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

_SYSLOG = parse.SYSLOG
_WS = text.WS


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_WS}+|{_WS}+$', '', 'g')"


def _group(i: int) -> str:
    return f"regexp_extract(line, '{_SYSLOG}', {i})"


_FIELDS = f""", lines AS (SELECT event_id, {_strip('value')} AS line FROM v_syslog),
fields AS (SELECT event_id, {_group(1)} AS month, {_group(2)} AS day, {_group(3)} AS time, {_group(4)} AS host,
  {_group(5)} AS service, {_group(6)} AS pid, {_group(7)} AS message
  FROM lines WHERE regexp_matches(line, '{_SYSLOG}'))
"""


@query("parse_syslog_fields", with_views("v_syslog") + _FIELDS + "SELECT * FROM fields")
def parse_syslog_fields(spark, sf):
    return parse.syslog_fields(table(spark, sf, "v_syslog"))


_TIME = """, timed AS (SELECT *, try_strptime('2024 ' || month || ' ' || day || ' ' || time, '%Y %b %d %H:%M:%S') AS y0,
  try_strptime('2023 ' || month || ' ' || day || ' ' || time, '%Y %b %d %H:%M:%S') AS y1 FROM fields)
"""


@query("parse_syslog_table", with_views("v_syslog") + _FIELDS + _TIME + """
SELECT event_id, strftime(coalesce(CASE WHEN y0 > TIMESTAMP '2024-01-20 12:00:00' THEN y1 ELSE y0 END, TIMESTAMP '2024-01-20 12:00:00'),
  '%Y-%m-%dT%H:%M:%SZ') AS timestamp, host, service, coalesce(TRY_CAST(nullif(pid, '') AS INT), -1) AS pid, message FROM timed""")
def parse_syslog_table(spark, sf):
    ref = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    parsed = parse.parse_syslog(table(spark, sf, "v_syslog"), ref)
    return parsed.withColumn("timestamp", text.iso(F.col("timestamp")))


@query("parse_bracketed", with_views("v_bracketed") + """
SELECT event_id, replace(split_part(value, ']', 1), '[', '') AS timestamp,
  replace(split_part(split_part(value, ']', 2), ':', 1), ' ', '') AS level,
  coalesce(nullif(regexp_extract(value, '([0-9]{1,3}\\.){3}[0-9]{1,3}', 0), ''), 'N/A') AS ip FROM v_bracketed""")
def parse_bracketed(spark, sf):
    return parse.parse_bracketed(table(spark, sf, "v_bracketed"))


_TRACE_PATH = """CASE WHEN lang = 'en' THEN 'Training_Data_Master/' WHEN lang = 'de' THEN 'Validation_Data/'
 WHEN lang = 'fr' THEN 'Attack_Data_Master/Adduser_1/' ELSE 'misc/' END || 'UTD-' || CAST(doc_id AS STRING) || '.txt'"""


@query("parse_traces", f"""
SELECT {_TRACE_PATH} AS filepath,
  CASE WHEN lang = 'en' THEN 'TRAINING' WHEN lang = 'de' THEN 'VALIDATE' WHEN lang = 'fr' THEN 'ATTACK' ELSE 'OTHER' END AS split,
  CAST(lang = 'fr' AS INT) AS is_anomaly, 'ADFA' AS host, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS message
FROM documents""")
def parse_traces(spark, sf):
    files = table(spark, sf, "documents").select(
        F.expr(_TRACE_PATH).alias("filepath"), F.col("text").alias("value"), F.lit(None).cast("timestamp").alias("modified"))
    return parse.parse_traces(files).drop("timestamp")


@query("parse_service_inference", with_views("v_logs") + """
SELECT event_id, CASE WHEN contains(message, 'ssh') THEN 'sshd'
  WHEN contains(message, 'httpd') OR contains(message, 'nginx') OR contains(message, 'apache') THEN 'httpd' ELSE 'system' END AS inferred,
  CASE WHEN lower(service) IN ('ssshd', 'ssh') THEN 'sshd' ELSE lower(service) END AS canonical FROM v_logs""")
def parse_service_inference(spark, sf):
    return table(spark, sf, "v_logs").select(
        "event_id", parse.service_from_message(F.col("message")).alias("inferred"),
        parse.canonical_service(F.col("service")).alias("canonical"))


@query("parse_message_ids", with_views("v_logs") + r"""
SELECT event_id, coalesce(nullif(regexp_extract(message, '\b\d{1,3}(?:\.\d{1,3}){3}\b', 0), ''), 'unknown') AS src_ip,
  coalesce(TRY_CAST(nullif(regexp_extract(message, 'pid=(\d+)', 1), '') AS INT), 0) AS pid,
  nullif(regexp_extract(message, '(blk_-?\d+)', 1), '') AS block_id FROM v_logs""")
def parse_message_ids(spark, sf):
    m = F.col("message")
    return table(spark, sf, "v_logs").select(
        "event_id", parse.source_ip(m).alias("src_ip"), parse.pid_from_message(m).alias("pid"), parse.block_id(m).alias("block_id"))


@query("parse_host_service_defaults", with_views("v_logs") + """
SELECT event_id, coalesce(nullif(trim(CASE WHEN k < 20 THEN '  ' WHEN k < 30 THEN NULL ELSE host END), ''), 'unknown') AS host,
  coalesce(nullif(trim(CASE WHEN k > 80 THEN '' ELSE ' ' || service END), ''), 'unknown') AS service FROM v_logs""")
def parse_host_service_defaults(spark, sf):
    logs = table(spark, sf, "v_logs").select(
        "event_id",
        F.expr("CASE WHEN k < 20 THEN '  ' WHEN k < 30 THEN NULL ELSE host END").alias("host"),
        F.expr("CASE WHEN k > 80 THEN '' ELSE ' ' || service END").alias("service"))
    return logs.select("event_id", parse.or_unknown(F.col("host")).alias("host"), parse.or_unknown(F.col("service")).alias("service"))


@query("parse_retime_replay", with_views("v_syslog") + """
SELECT event_id, 'Mar 05 06:07:08 ' || CASE WHEN len(string_split(value, ' ')) >= 4
  THEN array_to_string(list_slice(string_split(value, ' '), 4, len(string_split(value, ' '))), ' ') ELSE value END AS line FROM v_syslog""")
def parse_retime_replay(spark, sf):
    at = F.lit("2024-03-05 06:07:08").cast("timestamp_ntz")
    return table(spark, sf, "v_syslog").select("event_id", parse.retime(F.col("value"), at).alias("line"))


_JSON_DUCK = """, fed AS (SELECT event_id, CASE WHEN k < 20 THEN message WHEN k < 25 THEN '{broken' || message
  ELSE CAST(json_object('timestamp', strftime(timestamp, '%Y-%m-%d %H:%M:%S'), 'host', host, 'service', service,
    'message', message, 'prob_anomaly', prob_anomaly, 'source', source) AS VARCHAR) END AS value FROM v_logs)
"""


@query("parse_json_events", with_views("v_logs") + _JSON_DUCK + """
SELECT event_id, json_extract_string(value, '$.timestamp') AS timestamp, json_extract_string(value, '$.host') AS host,
  json_extract_string(value, '$.service') AS service, json_extract_string(value, '$.message') AS message,
  CAST(json_extract_string(value, '$.prob_anomaly') AS DOUBLE) AS prob_anomaly, json_extract_string(value, '$.source') AS source
FROM fed WHERE starts_with(value, '{') AND ends_with(value, '}')""")
def parse_json_events(spark, sf):
    return _json_rows(spark, sf)


@query("judged_json_events", with_views("v_logs") + _JSON_DUCK + """, j AS (
SELECT event_id, CAST(json_extract_string(value, '$.prob_anomaly') AS DOUBLE) AS p FROM fed WHERE starts_with(value, '{') AND ends_with(value, '}'))
SELECT event_id, CAST(p >= 0.60 AS INT) AS is_anomaly_pred, CASE WHEN p >= 0.85 THEN 'HIGH' WHEN p >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM j""")
def judged_json_events(spark, sf):
    from loghelm.operators.detect import judge_json
    return judge_json(_json_rows(spark, sf)).select("event_id", "is_anomaly_pred", "severity")


def _json_rows(spark, sf):
    fed = table(spark, sf, "v_logs").select("event_id", F.expr("""
        CASE WHEN k < 20 THEN message WHEN k < 25 THEN '{broken' || message
        ELSE to_json(named_struct('timestamp', date_format(timestamp, 'yyyy-MM-dd HH:mm:ss'), 'host', host, 'service', service,
             'message', message, 'prob_anomaly', prob_anomaly, 'source', source)) END""").alias("value"))
    return parse.json_events(fed, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
