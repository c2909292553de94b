"""Scoring, correlation and decision queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from loghelm.functions import scoring, text
from loghelm.operators import correlate, detect, parse
from loghelm.plans import sqltext as q
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

# The given events of one user lie hours apart, so the rule is widened.
WIDE_RULE = replace(correlate.SSH_BRUTEFORCE, window_seconds=168 * 3600, dedup_seconds=6 * 3600, block_seconds=48 * 3600)

KEYWORD_SCORE = ("least(CAST(0.99 AS DOUBLE), CAST(0.40 AS DOUBLE) + CAST(0.08 AS DOUBLE) * ("
                 + " + ".join(f"CAST(contains(lower(message), {q.quoted(w)}) AS INT)" for w in scoring.SCORE_KEYWORDS)
                 + ") + CASE WHEN contains(lower(message), 'failed password') THEN CAST(0.30 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)")


@query("keyword_scores", with_views("v_logs") + f"SELECT event_id, round({KEYWORD_SCORE}, 6) AS score FROM v_logs")
def keyword_scores(spark, sf):
    return table(spark, sf, "v_logs").select("event_id", F.round(scoring.keyword_score(F.col("message")), 6).alias("score"))


CUT = """CASE lower(service) WHEN 'sshd' THEN 0.70 WHEN 'cron' THEN 0.80 WHEN 'sendmail' THEN 0.85 WHEN 'rtkit-daemon' THEN 0.90 ELSE 0.65 END"""


@query("service_thresholds", with_views("v_logs") + f"""
SELECT event_id, CAST({CUT} AS DOUBLE) AS threshold, CAST(CASE WHEN service = 'CRON' THEN 0.65 ELSE {CUT} END AS DOUBLE) AS strict_threshold,
  CAST(prob_anomaly >= {CUT} AS INT) AS is_anomaly FROM v_logs""")
def service_thresholds(spark, sf):
    name = parse.canonical_service(F.col("service"))
    return table(spark, sf, "v_logs").select(
        "event_id", scoring.service_threshold(name).alias("threshold"),
        scoring.service_threshold(name, strict_reference=True).alias("strict_threshold"),
        (F.col("prob_anomaly") >= scoring.service_threshold(name)).cast("int").alias("is_anomaly"))


def _scale(high, medium):
    return f"CASE WHEN prob_anomaly >= {high} THEN 'HIGH' WHEN prob_anomaly >= {medium} THEN 'MEDIUM' ELSE 'LOW' END"


@query("severity_scales", with_views("v_logs") + f"""
SELECT event_id, {_scale(.75, .55)} AS live, {_scale(.85, .65)} AS tail, {_scale(.8, .6)} AS upload, {_scale(.8, .6)} AS dashboard,
  CASE {_scale(.75, .55)} WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END AS threat_score FROM v_logs""")
def severity_scales(spark, sf):
    p = F.col("prob_anomaly")
    return table(spark, sf, "v_logs").select(
        "event_id", *[scoring.severity(p, s).alias(s) for s in scoring.SEVERITY_SCALES],
        scoring.threat_score(scoring.severity(p, "live")).alias("threat_score"))


_PATTERN = "coalesce(" + ", ".join(
    f"CASE WHEN contains(lower(message), {q.quoted(p)}) THEN {q.quoted(p)} END" for p in correlate.SSH_BRUTEFORCE.patterns) + ")"


@query("rule_matches", with_views("v_logs") + f"SELECT event_id, {_PATTERN} AS matched_rule FROM v_logs")
def rule_matches(spark, sf):
    return table(spark, sf, "v_logs").select(
        "event_id", correlate.matched_pattern(F.col("message"), correlate.SSH_BRUTEFORCE).alias("matched_rule"))


def correlation_sql(view_sql: str, rule) -> str:
    """Recursive greedy chain, then a self-join count; the plain meaning of the rule."""
    gap, window = f"INTERVAL {rule.dedup_seconds} SECOND", f"INTERVAL {rule.window_seconds} SECOND"
    return view_sql + f""", tagged AS (SELECT *, {_PATTERN} AS pat,
  coalesce(nullif(regexp_extract(lower(message), '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', 0), ''), 'unknown') AS src_ip FROM v_logs),
hits AS (SELECT src_ip, lower(message) AS msg, timestamp AS t, min(event_id) AS event_id FROM tagged WHERE pat IS NOT NULL GROUP BY 1, 2, 3),
chain AS (SELECT src_ip, msg, min(t) AS t FROM hits GROUP BY 1, 2
  UNION ALL
  SELECT c.src_ip, c.msg, min(h.t) AS t FROM chain c JOIN hits h ON h.src_ip = c.src_ip AND h.msg = c.msg AND h.t > c.t + {gap} GROUP BY 1, 2),
accepted AS (SELECT h.event_id, h.src_ip, h.t FROM chain c JOIN hits h ON h.src_ip = c.src_ip AND h.msg = c.msg AND h.t = c.t),
counted AS (SELECT a.event_id, count(*) AS n FROM accepted a JOIN accepted b ON a.src_ip = b.src_ip AND b.t >= a.t - {window}
  AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id)) GROUP BY 1),
judged AS (SELECT tagged.*, coalesce(n, 0) AS n, coalesce(n, 0) >= {rule.correlation_threshold} AS hot FROM tagged LEFT JOIN counted USING (event_id)
  WHERE pat IS NULL OR n IS NOT NULL),
leveled AS (SELECT *, CASE WHEN hot AND n >= 5 THEN 'CRITICAL' WHEN hot THEN 'HIGH' ELSE {_scale(.75, .55)} END AS severity,
  CAST(hot OR prob_anomaly >= {CUT} AS INT) AS is_anomaly_pred FROM judged)
"""


_WIDE = correlation_sql(with_views("v_logs", recursive=True), WIDE_RULE)
_NARROW = correlation_sql(with_views("v_logs", recursive=True), correlate.SSH_BRUTEFORCE)


def _narrow_rows(spark, sf):
    logs = table(spark, sf, "v_logs")
    m = F.lower("message")
    return logs.where(correlate.matched_pattern(F.col("message"), WIDE_RULE).isNotNull()).select(
        F.unhex(F.md5(F.concat_ws(":", parse.source_ip(m), m))).alias("sig"), F.lit("ssh_bruteforce").alias("rule"),
        parse.source_ip(m).alias("ip"), correlate.micros(F.col("timestamp")).alias("us"), F.col("event_id").alias("id"))


@query("suppress_repeats", _WIDE + "SELECT event_id, src_ip FROM accepted")
def suppress_repeats(spark, sf):
    kept = correlate.accepted_events(_narrow_rows(spark, sf), WIDE_RULE.dedup_seconds, WIDE_RULE.block_micros)
    return kept.select(F.col("id").alias("event_id"), F.col("ip").alias("src_ip"))


@query("correlate_events", _WIDE + """
SELECT event_id, src_ip, pat AS matched_rule, CAST(n AS BIGINT) AS active_event_count, hot AS correlation_triggered FROM judged""")
def correlate_events(spark, sf):
    return correlate.correlate(table(spark, sf, "v_logs"), WIDE_RULE).select(
        "event_id", "src_ip", "matched_rule", "active_event_count", "correlation_triggered")


@query("correlate_events_minute", _NARROW + """
SELECT event_id, src_ip, pat AS matched_rule, CAST(n AS BIGINT) AS active_event_count, hot AS correlation_triggered FROM judged""")
def correlate_events_minute(spark, sf):
    return correlate.correlate(table(spark, sf, "v_logs")).select(
        "event_id", "src_ip", "matched_rule", "active_event_count", "correlation_triggered")


RECORDS = f"""SELECT event_id, {q.iso('timestamp')} AS timestamp, {q.iso('timestamp')} AS detected_at, host, service, message, prob_anomaly,
  is_anomaly_pred, pid, 'loghelm' AS model, source, severity, coalesce(pat, '') AS matched_rule, CAST(n AS BIGINT) AS active_event_count,
  hot AS correlation_triggered, CASE WHEN hot THEN 'Repeated behavioral correlation detected' ELSE 'ML semantic anomaly' END AS escalation_reason,
  CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END AS threat_score
FROM leveled WHERE is_anomaly_pred = 1"""
RECORDS_SQL = _WIDE + ", records AS (" + RECORDS + ")\n"


def records(spark, sf):
    """Anomaly records of the log view under the widened rule."""
    return detect.detect(table(spark, sf, "v_logs"), WIDE_RULE)


def shown(df):
    return df.withColumn("timestamp", text.iso(F.col("timestamp"))).withColumn("detected_at", text.iso(F.col("detected_at")))


@query("live_detection", _WIDE + RECORDS)
def live_detection(spark, sf):
    return shown(records(spark, sf))


@query("alert_lines", RECORDS_SQL + """
SELECT event_id, '[ALERT] Anomaly detected: time=' || detected_at || ' host=' || host || ' service=' || service || ' prob='
  || printf('%.3f', prob_anomaly) || ' severity=' || severity || chr(10) || '  msg: ' || substr(message, 1, 200) AS alert FROM records""")
def alert_lines(spark, sf):
    return detect.alert_lines(records(spark, sf), detect.ALERT_LENGTH).select("event_id", "alert")


@query("new_anomaly_notice", RECORDS_SQL + """, fresh AS (SELECT *, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS r
  FROM records WHERE detected_at > '2024-01-10T00:00:00Z' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 300))
SELECT count(*) AS new_anomalies, (SELECT service || ': ' || substr(message, 1, 140) FROM fresh f JOIN events e USING (event_id) ORDER BY r DESC, e.ts DESC, event_id DESC LIMIT 1) AS sample,
  CASE max(r) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS highest_severity FROM fresh""")
def new_anomaly_notice(spark, sf):
    told = table(spark, sf, "events").where("value > 300").select("event_id")
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return detect.new_anomaly_notice(records(spark, sf), told, "event_id", since, detect.NOTICE_LENGTH)


_SCAN_RULE = correlate.CorrelationRule("port_scan", ("port scan", "nmap"), 168 * 3600, 6 * 3600, 2, block_seconds=48 * 3600)


@query("rule_table_matches", with_views("v_logs") + f"""
SELECT event_id, CASE WHEN {_PATTERN} IS NOT NULL THEN 'ssh_bruteforce' WHEN contains(lower(message), 'port scan') OR contains(lower(message), 'nmap')
  THEN 'port_scan' END AS rule FROM v_logs""")
def rule_table_matches(spark, sf):
    return table(spark, sf, "v_logs").select("event_id", correlate.first_rule(F.col("message"), [WIDE_RULE, _SCAN_RULE]).alias("rule"))


@query("correlate_rule_table", _WIDE + """
SELECT event_id, 'ssh_bruteforce' AS rule, CAST(n AS BIGINT) AS active_event_count, hot AS correlation_triggered FROM judged WHERE pat IS NOT NULL""")
def correlate_rule_table(spark, sf):
    """The first rule's events come out of a two-rule table as they do alone."""
    out = correlate.correlate_rules(table(spark, sf, "v_logs"), [WIDE_RULE, _SCAN_RULE])
    return out.where("rule = 'ssh_bruteforce'").select("event_id", "rule", "active_event_count", "correlation_triggered")


_RULES = [WIDE_RULE, _SCAN_RULE]


def _by_rule(value, rule="rule") -> str:
    return f"CASE {rule} " + " ".join(f"WHEN '{r.name}' THEN {value(r)}" for r in _RULES) + " END"


# As correlation_sql, with the rule as one more key of chains and counts, and with the rows that match none.
_RULES_SQL = with_views("v_logs", recursive=True) + f""", named AS (SELECT *,
  CASE WHEN {_PATTERN} IS NOT NULL THEN 'ssh_bruteforce' WHEN contains(lower(message), 'port scan') OR contains(lower(message), 'nmap') THEN 'port_scan' END AS rule,
  coalesce({_PATTERN}, CASE WHEN contains(lower(message), 'port scan') THEN 'port scan' WHEN contains(lower(message), 'nmap') THEN 'nmap' END) AS pat,
  coalesce(nullif(regexp_extract(lower(message), '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', 0), ''), 'unknown') AS src_ip FROM v_logs),
hits AS (SELECT rule, src_ip, lower(message) AS msg, timestamp AS t, min(event_id) AS event_id FROM named WHERE rule IS NOT NULL GROUP BY 1, 2, 3, 4),
chain AS (SELECT rule, src_ip, msg, min(t) AS t FROM hits GROUP BY 1, 2, 3
  UNION ALL
  SELECT c.rule, c.src_ip, c.msg, min(h.t) AS t FROM chain c JOIN hits h ON h.rule = c.rule AND h.src_ip = c.src_ip AND h.msg = c.msg
    AND h.t > c.t + {_by_rule(lambda r: f"INTERVAL {r.dedup_seconds} SECOND", "c.rule")} GROUP BY 1, 2, 3),
accepted AS (SELECT h.event_id, h.rule, h.src_ip, h.t FROM chain c JOIN hits h ON h.rule = c.rule AND h.src_ip = c.src_ip AND h.msg = c.msg AND h.t = c.t),
counted AS (SELECT a.event_id, count(*) AS n FROM accepted a JOIN accepted b ON a.rule = b.rule AND a.src_ip = b.src_ip
  AND b.t >= a.t - {_by_rule(lambda r: f"INTERVAL {r.window_seconds} SECOND", "a.rule")}
  AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id)) GROUP BY 1)
SELECT event_id, src_ip, rule, pat AS matched_rule, CAST(coalesce(n, 0) AS BIGINT) AS active_event_count,
  rule IS NOT NULL AND n >= {_by_rule(lambda r: r.correlation_threshold)} AS correlation_triggered
FROM named LEFT JOIN counted USING (event_id) WHERE rule IS NULL OR n IS NOT NULL"""


RULES = _RULES
RULES_RECORDS_SQL = _RULES_SQL.rpartition("SELECT event_id, src_ip, rule")[0] + f""", judged AS (
SELECT named.*, coalesce(n, 0) AS n, rule IS NOT NULL AND coalesce(n, 0) >= {_by_rule(lambda r: r.correlation_threshold)} AS hot
FROM named LEFT JOIN counted USING (event_id) WHERE rule IS NULL OR n IS NOT NULL),
leveled AS (SELECT *, CASE WHEN hot AND n >= 5 THEN 'CRITICAL' WHEN hot THEN 'HIGH' ELSE {_scale(.75, .55)} END AS severity,
  CAST(hot OR prob_anomaly >= {CUT} AS INT) AS is_anomaly_pred FROM judged),
records AS (SELECT event_id, rule, prob_anomaly, severity, coalesce(pat, '') AS matched_rule, CAST(n AS BIGINT) AS active_event_count,
  hot AS correlation_triggered, CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END AS threat_score
  FROM leveled WHERE is_anomaly_pred = 1)
"""


@query("correlate_rule_table_all", _RULES_SQL)
def correlate_rule_table_all(spark, sf):
    """All rows of the two-rule table: either rule's events, and those that match none."""
    return correlate.correlate_rules(table(spark, sf, "v_logs"), _RULES).select(
        "event_id", "src_ip", "rule", "matched_rule", "active_event_count", "correlation_triggered")
