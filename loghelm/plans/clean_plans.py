"""Cleaning, normalising, labelling and dedup queries."""

from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import clean, dedup, label, normalize
from loghelm.plans import sqltext as q
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views
from loghelm.session import scratch_path
from loghelm.sources import readers

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("clean_messages", with_views("v_text") + f"""
SELECT kind, id, md5({q.collapsed(q.replaced("coalesce(text, '')", text.CLEAN_RULES))}) AS cleaned FROM v_text""")
def clean_messages(spark, sf):
    return table(spark, sf, "v_text").select("kind", "id", F.md5(text.clean_message(F.col("text"))).alias("cleaned"))


@query("clean_log_messages", with_views("v_logs") + f"""
SELECT event_id, {q.collapsed(q.replaced("coalesce(message, '')", text.CLEAN_RULES))} AS cleaned FROM v_logs""")
def clean_log_messages(spark, sf):
    return table(spark, sf, "v_logs").select("event_id", text.clean_message(F.col("message")).alias("cleaned"))


# The first masking set needs look-ahead, which the twin's regex engine lacks.
@query("mask_messages_v1")
def mask_messages_v1(spark, sf):
    return table(spark, sf, "v_text").select("kind", "id", text.mask_v1(F.col("text")).alias("masked"))


@query("mask_messages_v2", with_views("v_text") + f"""
SELECT kind, id, md5({q.collapsed(q.replaced("coalesce(text, '')", text.MASK_RULES_V2))}) AS masked FROM v_text""")
def mask_messages_v2(spark, sf):
    return table(spark, sf, "v_text").select("kind", "id", F.md5(text.mask_v2(F.col("text"))).alias("masked"))


@query("mask_identity_tokens", with_views("v_text") + f"""
SELECT kind, id, md5({q.replaced("lower(text)", text.IDENTITY_RULES)}) AS masked FROM v_text""")
def mask_identity_tokens(spark, sf):
    return table(spark, sf, "v_text").select("kind", "id", F.md5(text.mask_identity(F.lower("text"))).alias("masked"))


@query("fold_text", with_views("v_text") + f"""
SELECT kind, id, {q.collapsed('lower(text)')} AS folded FROM v_text""")
def fold_text(spark, sf):
    return clean.folded_message(table(spark, sf, "v_text"), "text").withColumnRenamed("text", "folded")


@query("truncate_messages", with_views("v_text") + """
SELECT kind, id, length(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || ' ...[truncated]' ELSE text END) AS size,
  md5(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || ' ...[truncated]' ELSE text END) AS body FROM v_text""")
def truncate_messages(spark, sf):
    cut = text.truncate(F.col("text"))
    return table(spark, sf, "v_text").select("kind", "id", F.char_length(cut).cast("long").alias("size"), F.md5(cut).alias("body"))


_VECTORS = """SELECT 'embedding' AS kind, vec_id AS id, {vec} AS text FROM embeddings
UNION ALL SELECT 'log' AS kind, event_id AS id, message AS text FROM {logs}"""


def _vector_rows(spark, sf):
    """Embeddings dumped as number lists next to real messages."""
    digits = "concat_ws(',', transform(embedding, x -> CAST(CAST(abs(x) * 10 AS INT) AS STRING)))"
    return spark.sql(_VECTORS.format(vec=digits, logs="{logs}").replace("FROM embeddings", "FROM {emb}"),
                     emb=table(spark, sf, "embeddings"), logs=table(spark, sf, "v_logs"))


_VEC_DUCK = with_views("v_logs") + ", rows_ AS (" + _VECTORS.format(
    vec="array_to_string(list_transform(embedding, lambda x: CAST(CAST(trunc(abs(x) * 10) AS INT) AS VARCHAR)), ',')", logs="v_logs") + """),
flagged AS (SELECT *, length(text) > 0
  AND (length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1) > 0.30
  AND len(regexp_extract_all(text, '\\p{Nd}')) / greatest(length(text), 1) > 0.50 AS bad FROM rows_)
"""


@query("quarantine_vector_rows", _VEC_DUCK + "SELECT kind, id, text FROM flagged WHERE bad")
def quarantine_vector_rows(spark, sf):
    return clean.split_vector_like(_vector_rows(spark, sf), "text")[1]


@query("keep_message_rows", _VEC_DUCK + "SELECT kind, id, text FROM flagged WHERE NOT bad")
def keep_message_rows(spark, sf):
    return clean.split_vector_like(_vector_rows(spark, sf), "text")[0]


_GAPPY = """SELECT event_id, CASE WHEN k < 10 THEN NULL WHEN k < 15 THEN ' NaN ' WHEN k < 20 THEN '   ' ELSE message END AS message,
 CASE WHEN k > 90 THEN NULL ELSE k END AS true_label FROM {logs}"""


def _gappy(spark, sf):
    return spark.sql(_GAPPY, logs=table(spark, sf, "v_logs"))


_GAPPY_DUCK = with_views("v_logs") + ", g AS (" + _GAPPY.format(logs="v_logs") + ")"


@query("drop_missing_rows", _GAPPY_DUCK + "SELECT * FROM g WHERE message IS NOT NULL AND true_label IS NOT NULL")
def drop_missing_rows(spark, sf):
    return clean.drop_missing(_gappy(spark, sf), "message", "true_label")


@query("missing_value_counts", _GAPPY_DUCK + """SELECT count(*) FILTER (event_id IS NULL) AS event_id,
 count(*) FILTER (message IS NULL) AS message, count(*) FILTER (true_label IS NULL) AS true_label FROM g""")
def missing_value_counts(spark, sf):
    return clean.missing_counts(_gappy(spark, sf))


@query("skip_empty_messages", _GAPPY_DUCK + """SELECT event_id, lower(trim(message)) AS message FROM g
 WHERE lower(trim(coalesce(message, ''))) NOT IN ('', 'nan')""")
def skip_empty_messages(spark, sf):
    return _gappy(spark, sf).where(clean.has_text(F.col("message"))).select(
        "event_id", F.lower(text.strip(F.col("message"))).alias("message"))


_UP = with_views("v_upload") + """, u AS (SELECT event_id, "HostName" AS host, svc AS service, "Msg" AS message, "Score" AS s,
 TRY_CAST("Score" AS DOUBLE) AS v FROM v_upload)
"""


@query("normalize_upload", _UP + f"""
SELECT event_id, '2024-02-01T00:00:00Z_' || substr(sha256('2024-02-01T00:00:00Z|' || message), 1, 16) AS anomaly_id,
  '2024-02-01T00:00:00Z' AS detected_at, '2024-02-01T00:00:00Z' AS timestamp, host, service, message,
  coalesce(least(1.0, greatest(0.0, CASE WHEN v > 1 THEN v / 100.0 ELSE v END)), 0.0) AS prob_anomaly,
  coalesce(CAST(v >= 0.65 AS INT), 0) AS is_anomaly_pred, 'upload' AS model, -1 AS pid, 'upload' AS source FROM u""")
def normalize_upload(spark, sf):
    return (normalize.normalize_upload(table(spark, sf, "v_upload"), "upload", as_of())
            .withColumn("detected_at", text.iso(F.col("detected_at"))).withColumn("timestamp", text.iso(F.col("timestamp"))))


@query("normalize_file_import", with_views("v_upload") + f"""
SELECT event_id, strftime(coalesce(TRY_CAST("Time" AS TIMESTAMP), TIMESTAMP '{AS_OF}'), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  '2024-02-01T00:00:00Z' AS detected_at, "HostName" AS host, svc AS service, 'replay' AS source FROM v_upload""")
def normalize_file_import(spark, sf):
    out = normalize.normalize_upload(table(spark, sf, "v_upload"), "replay", as_of())
    return out.select("event_id", text.iso(F.col("timestamp")).alias("timestamp"), text.iso(F.col("detected_at")).alias("detected_at"),
                      "host", "service", "source")


_ZONES = """CASE k % 5 WHEN 0 THEN '+05' WHEN 1 THEN '-03:30' WHEN 2 THEN ' Asia/Kolkata' WHEN 3 THEN 'Z' ELSE '' END"""


@query("normalize_zoned_times", with_views("v_upload", "v_logs") + """
SELECT event_id, strftime(date_trunc('second', timestamp) - CASE k % 5 WHEN 0 THEN INTERVAL 300 MINUTE WHEN 1 THEN -INTERVAL 210 MINUTE
  WHEN 2 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM v_logs""")
def normalize_zoned_times(spark, sf):
    """Times with an offset of hours, of hours and minutes, a zone's name, Z or nothing behind them."""
    logs = table(spark, sf, "v_logs")
    written = logs.select("event_id", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.expr(_ZONES)).alias("Time"), F.col("message").alias("Msg"))
    return normalize.normalize_upload(written, "replay", as_of()).select("event_id", text.iso(F.col("timestamp")).alias("timestamp"))


@query("normalize_label_sources", with_views("v_feedback") + """
SELECT seq, fb_label AS from_label, CAST(prob_anomaly >= 0.65 AS INT) AS from_prob, 0 AS without FROM v_feedback""")
def normalize_label_sources(spark, sf):
    fb = table(spark, sf, "v_feedback")
    by_label = fb.withColumnRenamed("fb_label", "true_label")
    return by_label.select("seq", normalize.resolved_label(by_label).alias("from_label"),
                           normalize.resolved_label(fb.select("seq", "prob_anomaly")).alias("from_prob"),
                           normalize.resolved_label(fb.select("seq")).alias("without"))


@query("case_identity", with_views("v_logs") + """
SELECT event_id, strftime(detected_at, '%Y-%m-%dT%H:%M:%SZ') || '|' || host || '|' || service || '|LOW|' || source || '|' || trim(message) AS case_id
FROM v_logs""")
def case_identity(spark, sf):
    return table(spark, sf, "v_logs").select("event_id", normalize.case_id(
        F.col("detected_at"), F.col("host"), F.col("service"), F.lit(None).cast("string"), F.col("source"), F.col("message")).alias("case_id"))


_STORED = with_views("v_stored") + f""", typed AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS t,
  coalesce(TRY_CAST(detected_at AS TIMESTAMP), TRY_CAST(timestamp AS TIMESTAMP), TIMESTAMP '{AS_OF}') AS d,
  {q.collapsed('message')} AS m FROM v_stored
  WHERE NOT (trim(timestamp) = 'timestamp' AND trim(detected_at) = 'detected_at' AND trim(host) = 'host' AND trim(service) = 'service'
    AND trim(message) = 'message' AND trim(prob_anomaly) = 'prob_anomaly' AND trim(is_anomaly_pred) = 'is_anomaly_pred'
    AND trim(pid) = 'pid' AND trim(source) = 'source' AND trim(severity) = 'severity')
  AND NOT (timestamp = '' AND detected_at = '' AND host = '' AND service = '' AND message = '' AND prob_anomaly = ''
    AND is_anomaly_pred = '' AND pid = '' AND source = '' AND severity = ''))
"""


@query("repair_stored_table", _STORED + f"""
SELECT event_id, coalesce({q.iso('t')}, '') AS timestamp, {q.iso('d')} AS detected_at, host, service,
  CASE WHEN length(m) > 8000 THEN substr(m, 1, 8000) || ' ...[truncated]' ELSE m END AS message,
  coalesce(TRY_CAST(prob_anomaly AS DOUBLE), 0.0) AS prob_anomaly, coalesce(TRY_CAST(is_anomaly_pred AS INT), 0) AS is_anomaly_pred,
  coalesce(TRY_CAST(pid AS INT), -1) AS pid, '' AS model, source, coalesce(nullif(severity, ''), 'LOW') AS severity
FROM typed WHERE NOT (m = '' AND trim(host) = '')""")
def repair_stored_table(spark, sf):
    path = scratch_path(spark, "stored")
    table(spark, sf, "v_stored").write.option("header", True).option("escape", '"').csv(path)
    fixed = normalize.repair_stored(readers.csv_strings(spark, path), as_of(), text.MESSAGE_LIMIT)
    # A sort reads its input twice: what is repaired is written, so that files are parsed once.
    repaired = scratch_path(spark, "repaired")
    fixed.withColumn("event_id", F.col("event_id").cast("long")).write.parquet(repaired)
    return (spark.read.parquet(repaired).orderBy(F.desc("detected_at"))
            .withColumn("timestamp", normalize.json_text(F.col("timestamp"), "timestamp"))
            .withColumn("detected_at", text.iso(F.col("detected_at")))
            .drop("matched_rule", "active_event_count", "correlation_triggered", "escalation_reason"))


@query("strict_records", with_views("v_stored") + """
SELECT event_id, timestamp, detected_at, host, service, message, coalesce(TRY_CAST(prob_anomaly AS DOUBLE), 0.0) AS prob_anomaly,
  coalesce(TRY_CAST(is_anomaly_pred AS INT), 0) AS is_anomaly_pred, coalesce(TRY_CAST(pid AS INT), -1) AS pid, '' AS model, source,
  upper(coalesce(nullif(severity, ''), 'LOW')) AS severity, '' AS matched_rule, '' AS active_event_count, '' AS correlation_triggered,
  '' AS escalation_reason FROM v_stored""")
def strict_records(spark, sf):
    return normalize.strict_record(table(spark, sf, "v_stored"))


@query("fill_canonical_columns", with_views("v_logs") + """
SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, strftime(detected_at, '%Y-%m-%dT%H:%M:%SZ') AS detected_at, host, service, message,
  prob_anomaly, 0 AS is_anomaly_pred, pid, 'upload' AS model, source, 'LOW' AS severity, '' AS matched_rule, CAST(0 AS BIGINT) AS active_event_count,
  false AS correlation_triggered, '' AS escalation_reason FROM v_logs""")
def fill_canonical_columns(spark, sf):
    out = normalize.fill_canonical(table(spark, sf, "v_logs").drop("value", "k"))
    return (out.drop("threat_score").withColumn("timestamp", text.iso(F.col("timestamp")))
            .withColumn("detected_at", text.iso(F.col("detected_at"))))


@query("labelled_corpora", with_views("v_logs") + """
SELECT message, CAST(event_type = 'error' AS INT) AS true_label, 'hdfs' AS source_dataset FROM v_logs
UNION ALL SELECT message, CAST(CASE WHEN k < 10 THEN '-' WHEN k < 20 THEN 'Abnormal' ELSE 'FATAL' END IN ('-', 'Abnormal') AS INT), 'bgl' FROM v_logs""")
def labelled_corpora(spark, sf):
    logs = table(spark, sf, "v_logs")
    first = logs.select(F.col("message").alias("Content"), F.expr("CAST(event_type = 'error' AS INT)").alias("true_label"))
    second = logs.select(F.col("message").alias("log"), F.expr("CASE WHEN k < 10 THEN '-' WHEN k < 20 THEN 'Abnormal' ELSE 'FATAL' END").alias("Label"))
    return normalize.labelled_corpus(first, "hdfs").unionByName(
        normalize.labelled_corpus(second, "bgl", normalize.POSITIVE_WORDS_DASH))


@query("row_number_time", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS timestamp FROM documents")
def row_number_time(spark, sf):
    return normalize.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("display_time_zones", with_views("v_logs") + """
SELECT event_id, strftime(detected_at, '%H:00') AS utc_hour, strftime(detected_at + INTERVAL 330 MINUTE, '%Y-%m-%d %H:00') AS ist_hour FROM v_logs""")
def display_time_zones(spark, sf):
    return table(spark, sf, "v_logs").select(
        "event_id", F.date_format(normalize.display_time(F.col("detected_at"), "UTC"), "HH:'00'").alias("utc_hour"),
        F.date_format(normalize.display_time(F.col("detected_at"), "IST"), "yyyy-MM-dd HH:'00'").alias("ist_hour"))


@query("json_safe_values", with_views("v_logs") + """
SELECT event_id, coalesce(strftime(CASE WHEN k < 10 THEN NULL ELSE detected_at END, '%Y-%m-%dT%H:%M:%SZ'), '') AS detected_at,
  coalesce(CASE WHEN k < 30 THEN NULL ELSE host END, '') AS host, coalesce(CAST(CASE WHEN k < 50 THEN NULL ELSE k END AS VARCHAR), '') AS k FROM v_logs""")
def json_safe_values(spark, sf):
    return table(spark, sf, "v_logs").select(
        "event_id",
        normalize.json_text(F.expr("CASE WHEN k < 10 THEN NULL ELSE detected_at END"), "timestamp").alias("detected_at"),
        normalize.json_text(F.expr("CASE WHEN k < 30 THEN NULL ELSE host END"), "text").alias("host"),
        normalize.json_text(F.expr("CASE WHEN k < 50 THEN CAST('NaN' AS DOUBLE) ELSE k END").cast("double"), "number").alias("k"),
    ).withColumn("k", F.regexp_replace("k", r"\.0$", ""))


@query("weak_labels", with_views("v_logs") + f"""
SELECT event_id, CAST(regexp_matches(lower(message), '{'|'.join(label.ANOMALY_WORDS + label.ANOMALY_PATTERNS)}') AS INT) AS keyword_label,
  CAST(regexp_matches(message, '(?i)error|fail|refused') AS INT) AS alarm_label,
  CAST(pid < 10 OR contains(lower(service), 'sendmail') AS INT) AS process_label FROM v_logs""")
def weak_labels(spark, sf):
    pid = F.expr("CASE WHEN pid >= 10 THEN pid END")
    return table(spark, sf, "v_logs").select(
        "event_id", label.keyword_label(F.col("message")).alias("keyword_label"),
        label.alarm_word_label(F.col("message")).alias("alarm_label"),
        label.process_label(pid, F.col("service")).alias("process_label"))


@query("level_labels", with_views("v_bracketed") + """
SELECT event_id, level, CAST(level IN ('ERROR', 'CRITICAL') OR ip IS NULL AS INT) AS is_anomaly FROM (
 SELECT event_id, replace(split_part(split_part(value, ']', 2), ':', 1), ' ', '') AS level,
   nullif(regexp_extract(value, '([0-9]{1,3}\\.){3}[0-9]{1,3}', 0), '') AS ip FROM v_bracketed)""")
def level_labels(spark, sf):
    from loghelm.operators import parse
    parsed = parse.parse_bracketed(table(spark, sf, "v_bracketed"))
    ip = F.nullif(F.col("ip"), F.lit("N/A"))
    return parsed.select("event_id", "level", label.level_label(F.col("level"), ip).alias("is_anomaly"))


@query("block_label_lookup", with_views("v_block_labels") + """, dim AS (
 SELECT "BlockId" AS b, arg_max(CAST(lower("Label") IN ('anomaly', 'abnormal', '1') AS INT), seq) AS y FROM v_block_labels GROUP BY 1)
SELECT event_id, nullif(regexp_extract(message, '(blk_-?\\d+)', 1), '') AS block_id, coalesce(y, 0) AS true_label
FROM v_logs LEFT JOIN dim ON b = nullif(regexp_extract(message, '(blk_-?\\d+)', 1), '')""")
def block_label_lookup(spark, sf):
    dim = table(spark, sf, "v_block_labels").select(
        F.col("BlockId").alias("block_id"), normalize.text_label(F.col("Label")).alias("true_label"), "seq")
    return label.lookup_block_labels(table(spark, sf, "v_logs").select("event_id", "message"), dim, "seq").drop("message")


_FB = with_views("v_feedback") + """, fb AS (SELECT *, CASE WHEN action = 'false_positive' THEN 0 ELSE 1 END AS label,
  CASE WHEN round(prob_anomaly, 3) >= 0.8 THEN 1 WHEN round(prob_anomaly, 3) <= 0.3 THEN 0 END AS suggested_label FROM v_feedback)
"""


@query("feedback_agreement", _FB + "SELECT seq, action, label, suggested_label, label = suggested_label AS agreement FROM fb")
def feedback_agreement(spark, sf):
    return label.feedback_log(table(spark, sf, "v_feedback")).select("seq", "action", "label", "suggested_label", "agreement")


@query("feedback_agreement_rate", _FB + """
SELECT action, count(suggested_label) AS rated, count(*) FILTER (label = suggested_label) AS agreed,
  round(count(*) FILTER (label = suggested_label) / nullif(count(suggested_label), 0), 6) AS agreement_rate FROM fb GROUP BY action""")
def feedback_agreement_rate(spark, sf):
    return label.agreement_rate(label.feedback_log(table(spark, sf, "v_feedback")), ["action"])


@query("feedback_training_set", _FB + """
SELECT seq, trim(fb_message) AS message, CASE action WHEN 'closed' THEN 1 ELSE 0 END AS true_label FROM fb
WHERE action IN ('closed', 'false_positive') AND trim(fb_message) <> ''""")
def feedback_training_set(spark, sf):
    return label.feedback_training_set(table(spark, sf, "v_feedback"), "fb_message").select("seq", "message", "true_label")


def _feedback_rows(spark, sf):
    return table(spark, sf, "v_feedback").select("seq", F.col("fb_message").alias("message"), F.col("fb_label").alias("true_label"))


_CONFLICT = with_views("v_feedback") + """, pairs AS (SELECT fb_message AS message, fb_label AS true_label, min(seq) AS first_at, count(*) AS n FROM v_feedback GROUP BY 1, 2),
lasts AS (SELECT message, true_label FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY first_at DESC) AS rn FROM pairs) WHERE rn = 1)
"""


@query("resolve_feedback_conflicts", _CONFLICT + "SELECT * FROM lasts WHERE true_label IN (0, 1)")
def resolve_feedback_conflicts(spark, sf):
    return dedup.resolve_feedback(_feedback_rows(spark, sf), "seq")


@query("feedback_cleaning_report", _CONFLICT + """
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM pairs) AS initial_rows, (SELECT count(*) FROM pairs) AS distinct_rows,
  (SELECT count(*) FROM pairs) - (SELECT count(*) FROM lasts) AS conflicts_resolved,
  (SELECT count(*) FROM lasts WHERE true_label IN (0, 1)) AS final_rows,
  (SELECT CAST(sum(n) AS BIGINT) FROM pairs) - (SELECT count(*) FROM lasts WHERE true_label IN (0, 1)) AS removed_rows""")
def feedback_cleaning_report(spark, sf):
    return dedup.feedback_report(_feedback_rows(spark, sf), "seq")


@query("dedup_records", with_views("v_logs") + """
SELECT event_id, row_key FROM (SELECT event_id, substr(sha256(key), 1, 16) AS row_key,
  row_number() OVER (PARTITION BY key ORDER BY detected_at, event_id) AS rn
  FROM (SELECT *, trim(host) || '|' || trim(service) || '|' || CASE WHEN pid = 0 THEN '' ELSE CAST(pid AS VARCHAR) END || '|' || trim(message) AS key FROM v_logs)) WHERE rn = 1""")
def dedup_records(spark, sf):
    return dedup.first_records(
        table(spark, sf, "v_logs").select("event_id", "detected_at", "host", "service", "pid", "message"),
        ["detected_at", "event_id"]).select("event_id", "row_key")


@query("dedup_timed_records", with_views("v_logs") + """
SELECT event_id, row_key FROM (SELECT event_id, substr(sha256(key), 1, 16) AS row_key, row_number() OVER (PARTITION BY key ORDER BY event_id) AS rn
  FROM (SELECT *, strftime(date_trunc('day', detected_at), '%Y-%m-%dT%H:%M:%SZ') || '|' || host || '|' || service || '|' || message AS key FROM v_logs)) WHERE rn = 1""")
def dedup_timed_records(spark, sf):
    logs = table(spark, sf, "v_logs").withColumn("detected_at", F.date_trunc("day", "detected_at").cast("timestamp_ntz"))
    return dedup.first_timed_records(logs.select("event_id", "detected_at", "timestamp", "host", "service", "message"),
                                     ["event_id"]).select("event_id", "row_key")


@query("duplicate_documents", """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY 1, 2, 3)""")
def duplicate_documents(spark, sf):
    return dedup.duplicate_counts(table(spark, sf, "documents").select("text", "lang", "source"))


@query("distinct_messages", with_views("v_logs") + "SELECT DISTINCT service, message FROM v_logs")
def distinct_messages(spark, sf):
    return table(spark, sf, "v_logs").select("service", "message").dropDuplicates()
