"""Anomaly list, counter and report queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import query as ops
from loghelm.plans import sqltext as q
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

AS_OF = "2024-01-30 12:34:56"
_A = with_views("v_anoms")
_SRC = "CASE lower(trim(source)) WHEN 'uploads' THEN 'upload' ELSE lower(trim(source)) END"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _shown(df):
    return df.withColumn("detected_at", text.iso(F.col("detected_at")))


_LIST = f"SELECT event_id, {q.iso('detected_at')} AS detected_at, host, service, message, prob_anomaly, severity, pid, source FROM v_anoms WHERE is_anomaly_pred = 1"
_LIST_COLS = ["event_id", "detected_at", "host", "service", "message", "prob_anomaly", "severity", "pid", "source"]


@query("anomaly_list", _A + _LIST + " ORDER BY v_anoms.detected_at DESC, event_id DESC LIMIT 200")
def anomaly_list(spark, sf):
    return _shown(ops.list_anomalies(table(spark, sf, "v_anoms"), tie="event_id").select(*_LIST_COLS))


@query("anomaly_list_filtered", _A + _LIST + f""" AND {_SRC} = 'upload' AND lower(trim(service)) = 'sshd' AND lower(trim(host)) = 'host-3'
  AND v_anoms.detected_at >= TIMESTAMP '2024-01-05 00:00:00' AND v_anoms.detected_at <= TIMESTAMP '2024-01-25 00:00:00'""")
def anomaly_list_filtered(spark, sf):
    out = ops.list_anomalies(table(spark, sf, "v_anoms"), limit=0, source="uploads", service=" SSHD ", host="HOST-3",
                             start="2024-01-05T00:00:00Z", end="2024-01-25T00:00:00Z")
    return _shown(out.select(*_LIST_COLS))


@query("anomaly_list_bad_bounds", _A + _LIST)
def anomaly_list_bad_bounds(spark, sf):
    out = ops.list_anomalies(table(spark, sf, "v_anoms"), limit=-1, source="all", start="yesterday", end="")
    return _shown(out.select(*_LIST_COLS))


_COUNTS = f"""SELECT count(*) AS total, count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE) AS last_10_minutes,
  count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE) AS last_1_hour,
  count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1440 MINUTE) AS last_24_hours FROM v_anoms WHERE is_anomaly_pred = 1"""
_SERVICES = "SELECT coalesce(nullif(trim(service), ''), 'unknown') AS service, count(*) AS anomalies FROM v_anoms WHERE is_anomaly_pred = 1 GROUP BY 1"


@query("anomaly_counters", _A + _COUNTS)
def anomaly_counters(spark, sf):
    return ops.counters(ops.true_anomalies(table(spark, sf, "v_anoms")), _as_of())


@query("anomalies_by_service", _A + _SERVICES)
def anomalies_by_service(spark, sf):
    return ops.by_service(ops.true_anomalies(table(spark, sf, "v_anoms")))


@query("anomaly_stats", _A + f""", c AS ({_COUNTS}), s AS ({_SERVICES})
SELECT 'counts' AS section, 'total' AS name, total AS value FROM c UNION ALL SELECT 'counts', 'last_10_minutes', last_10_minutes FROM c
UNION ALL SELECT 'counts', 'last_1_hour', last_1_hour FROM c UNION ALL SELECT 'counts', 'last_24_hours', last_24_hours FROM c
UNION ALL SELECT 'counts', 'datasets_analyzed', count(DISTINCT source) FROM documents UNION ALL SELECT 'by_service', service, anomalies FROM s""")
def anomaly_stats(spark, sf):
    catalogue = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return ops.stats(ops.true_anomalies(table(spark, sf, "v_anoms")), catalogue, _as_of())


def _hours(shift: int) -> str:
    return _A + f""", n AS (SELECT date_trunc('minute', TIMESTAMP '{AS_OF}') AS now_),
f AS (SELECT strftime(detected_at + INTERVAL {shift} MINUTE, '%H:00') AS hour, count(*) AS n FROM v_anoms, n
  WHERE detected_at >= now_ - INTERVAL 1440 MINUTE AND detected_at <= now_ GROUP BY 1)
SELECT p.i AS position, strftime(now_ + INTERVAL {shift} MINUTE - to_hours(CAST(23 - p.i AS BIGINT)), '%H:00') AS hour, coalesce(f.n, 0) AS anomalies
FROM (SELECT unnest(range(24)) AS i) p, n LEFT JOIN f ON f.hour = strftime(now_ + INTERVAL {shift} MINUTE - to_hours(CAST(23 - p.i AS BIGINT)), '%H:00')"""


@query("hourly_activity", _hours(0))
def hourly_activity(spark, sf):
    return ops.hourly_activity(table(spark, sf, "v_anoms"), _as_of())


@query("hourly_activity_ist", _hours(330))
def hourly_activity_ist(spark, sf):
    return ops.hourly_activity(table(spark, sf, "v_anoms"), _as_of(), 330)


@query("severity_order", _A + """SELECT event_id, severity, row_number() OVER (
  ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, detected_at DESC, event_id) AS position FROM v_anoms""")
def severity_order(spark, sf):
    return ops.severity_positions(table(spark, sf, "v_anoms"), "event_id").select("event_id", "severity", "position")


@query("top_threats", _A + "SELECT event_id, threat_score FROM v_anoms ORDER BY threat_score DESC, timestamp DESC, event_id DESC LIMIT 5")
def top_threats(spark, sf):
    return ops.threat_order(table(spark, sf, "v_anoms"), tie="event_id").select("event_id", "threat_score")


@query("severity_counts", _A + """SELECT count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity NOT IN ('HIGH', 'MEDIUM')) AS low FROM v_anoms""")
def severity_counts(spark, sf):
    return ops.severity_counts(table(spark, sf, "v_anoms"))


@query("threat_level", _A + """SELECT high, medium, round(top, 6) AS max_threat, CASE WHEN high >= 30 AND top >= 98 THEN 'CRITICAL' WHEN high >= 5 OR top >= 85 THEN 'HIGH'
  WHEN medium >= 3 OR top >= 60 THEN 'ELEVATED' ELSE 'NORMAL' END AS level, top >= 100 AS banner
FROM (SELECT count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, coalesce(max(prob_anomaly * 100), 0.0) AS top FROM v_anoms)""")
def threat_level(spark, sf):
    return ops.threat_level(table(spark, sf, "v_anoms"))


@query("service_summary", _A + f"""SELECT service, count(*) AS anomalies, round(avg(prob_anomaly), 6) AS avg_probability, {q.iso('max(detected_at)')} AS latest
FROM v_anoms WHERE {_SRC} = 'live' GROUP BY 1""")
def service_summary(spark, sf):
    out = ops.service_summary(ops.source_mode(table(spark, sf, "v_anoms"), "live"))
    return out.withColumn("latest", text.iso(F.col("latest")))


@query("source_and_severity_filter", _A + f"SELECT event_id, source, severity FROM v_anoms WHERE {_SRC} = 'upload' AND severity = 'HIGH'")
def source_and_severity_filter(spark, sf):
    return ops.severity_filter(ops.source_mode(table(spark, sf, "v_anoms"), "upload"), "HIGH").select("event_id", "source", "severity")


_LAST = """, lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY action_time DESC, status DESC) AS rn
  FROM v_actions WHERE status IN ('acknowledged', 'closed', 'false_positive')) WHERE rn = 1)
"""


@query("latest_actions", with_views("v_actions") + _LAST + f"SELECT anomaly_id, status, comment, {q.iso('action_time')} AS action_time FROM lasts")
def latest_actions(spark, sf):
    return ops.latest_actions(table(spark, sf, "v_actions")).withColumn("action_time", text.iso(F.col("action_time")))


@query("case_status", with_views("v_anoms", "v_actions") + _LAST + """
SELECT event_id, upper(coalesce(status, 'new')) AS status, coalesce(comment, '') AS comment FROM v_anoms LEFT JOIN lasts ON anomaly_id = event_id""")
def case_status(spark, sf):
    return ops.case_status(table(spark, sf, "v_anoms"), table(spark, sf, "v_actions"), "event_id").select("event_id", "status", "comment")


@query("status_counts", with_views("v_anoms", "v_actions") + _LAST + """
SELECT upper(coalesce(status, 'new')) AS status, count(*) AS anomalies FROM v_anoms LEFT JOIN lasts ON anomaly_id = event_id GROUP BY 1""")
def status_counts(spark, sf):
    joined = ops.case_status(table(spark, sf, "v_anoms").select("event_id"), table(spark, sf, "v_actions"), "event_id")
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("anomalies"))


@query("retraining_history", with_views("v_history") + "SELECT *, row_number() OVER (ORDER BY timestamp) AS run FROM v_history")
def retraining_history(spark, sf):
    # one row a run
    return table(spark, sf, "v_history").withColumn("run", F.row_number().over(W.orderBy("timestamp")).cast("long"))


@query("latest_retraining", with_views("v_history") + """
SELECT *, substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2) || '-' || substr(timestamp, 7, 2) || ' 12:00' AS shown_time
FROM v_history ORDER BY timestamp DESC LIMIT 1""")
def latest_retraining(spark, sf):
    return ops.latest_run(table(spark, sf, "v_history"))


_C = with_views("v_corpus")


@query("label_distribution", _C + "SELECT true_label, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM v_corpus GROUP BY 1")
def label_distribution(spark, sf):
    return ops.label_distribution(table(spark, sf, "v_corpus"), "true_label")


@query("dataset_crosstab", _C + """SELECT source_dataset, count(*) FILTER (true_label = 0) AS label_0, count(*) FILTER (true_label = 1) AS label_1
FROM v_corpus GROUP BY 1""")
def dataset_crosstab(spark, sf):
    return ops.label_crosstab(table(spark, sf, "v_corpus"), "source_dataset", "true_label")


@query("dataset_summary", _C + """SELECT coalesce(source_dataset, 'combined') AS dataset, count(*) AS total_records,
  count(*) FILTER (true_label = 0) AS normal_records, count(*) FILTER (true_label = 1) AS anomalous_records,
  round(count(*) FILTER (true_label = 1) / count(*) * 100, 2) AS anomaly_rate FROM v_corpus GROUP BY ROLLUP (source_dataset)""")
def dataset_summary(spark, sf):
    return ops.dataset_summary(table(spark, sf, "v_corpus"), "source_dataset", "true_label")


@query("data_audit", with_views("v_feedback") + f"""SELECT count(*) AS row_count, 4 AS column_count, count(*) FILTER (label IS NULL) AS missing_cells,
  count(*) FILTER (label = 1) AS anomalies, count(*) FILTER (label = 0) AS normals, {q.iso('min(action_time)')} AS first_time, {q.iso('max(action_time)')} AS last_time
FROM (SELECT *, nullif(fb_label, 7) AS label FROM v_feedback)""")
def data_audit(spark, sf):
    df = table(spark, sf, "v_feedback").select("seq", "message", F.nullif("fb_label", F.lit(7)).alias("label"), "action_time")
    return ops.audit(df, "label", "action_time").withColumn("first_time", text.iso(F.col("first_time"))).withColumn(
        "last_time", text.iso(F.col("last_time")))


@query("anomaly_samples", with_views("v_corpus") + "SELECT id, message FROM v_corpus WHERE true_label = 1 ORDER BY id LIMIT 10")
def anomaly_samples(spark, sf):
    return table(spark, sf, "v_corpus").where("true_label = 1").select("id", "message").orderBy("id").limit(10)


@query("longest_messages", with_views("v_messages") + """SELECT id, length(message) AS message_length, substr(message, 1, 1000) AS preview FROM v_messages
ORDER BY message_length DESC, id LIMIT 5""")
def longest_messages(spark, sf):
    return ops.longest_messages(table(spark, sf, "v_messages"), "id")


@query("split_distribution", """SELECT CASE WHEN lang = 'en' THEN 'TRAINING' WHEN lang = 'de' THEN 'VALIDATE' WHEN lang = 'fr' THEN 'ATTACK' ELSE 'OTHER' END AS split,
  count(*) AS rows FROM documents GROUP BY 1""")
def split_distribution(spark, sf):
    from loghelm.operators.parse import trace_split
    path = F.expr("CASE lang WHEN 'en' THEN 'Training_Data/a' WHEN 'de' THEN 'Validation_Data/a' WHEN 'fr' THEN 'Attack_Data/a' ELSE 'misc/a' END")
    return table(spark, sf, "documents").groupBy(trace_split(path).alias("split")).agg(F.count(F.lit(1)).alias("rows"))


@query("union_with_feedback", with_views("v_corpus", "v_feedback") + """
SELECT message, true_label, source_dataset FROM v_corpus UNION ALL SELECT fb_message, fb_label, NULL FROM v_feedback WHERE fb_label IN (0, 1)""")
def union_with_feedback(spark, sf):
    fb = table(spark, sf, "v_feedback").where("fb_label IN (0, 1)").select(
        F.col("fb_message").alias("message"), F.col("fb_label").alias("true_label"))
    return table(spark, sf, "v_corpus").drop("id").unionByName(fb, allowMissingColumns=True)


@query("uniform_sample", with_views("v_messages") + "SELECT id, source_dataset FROM v_messages ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 300")
def uniform_sample(spark, sf):
    return ops.uniform_sample(table(spark, sf, "v_messages"), "id", 300).select("id", "source_dataset")
