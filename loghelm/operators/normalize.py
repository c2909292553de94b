"""Loose tables to the canonical schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators.ranking import ranged, running_totals
from loghelm.schemas import ANOMALY_SCHEMA, STORED_FIELDS

# Header synonyms of uploaded tables, tried in this order.
HEADER_SYNONYMS = {
    "time": "timestamp",
    "ts": "timestamp",
    "datetime": "timestamp",
    "date": "timestamp",
    "host_name": "host",
    "hostname": "host",
    "svc": "service",
    "service_name": "service",
    "process": "service",
    "msg": "message",
    "log": "message",
    "text": "message",
    "event": "message",
    "score": "prob_anomaly",
    "prob": "prob_anomaly",
    "probability": "prob_anomaly",
    "content": "message",
    "anomaly_prob": "prob_anomaly",
    "anomaly_score": "prob_anomaly",
}
# Candidate columns of training tables, first match wins.
MESSAGE_CANDIDATES = ["Content", "content", "message", "log", "EventTemplate"]
TEXT_CANDIDATES = ["Content", "message", "log", "text", "line", "event", "description"]
LABEL_CANDIDATES = ["Label", "label", "true_label"]
BLOCK_CANDIDATES = ["BlockId", "Block ID", "blkId"]
AUDIT_LABELS = ["is_anomaly", "label", "target", "class", "y"]
# Label words that mean anomaly; the second set also counts "-".
POSITIVE_WORDS = ["anomaly", "abnormal", "1"]
POSITIVE_WORDS_DASH = [*POSITIVE_WORDS, "-"]
# Label cut and the probabilities that stand in for a label.
LABEL_CUT = 0.65
PROB_IF_POSITIVE = 0.95


def rename_headers(df: DataFrame) -> DataFrame:
    """Lower-case trimmed headers, synonyms renamed unless the target exists."""
    names = [c.strip().lower() for c in df.columns]
    for old, new in HEADER_SYNONYMS.items():
        if old in names and new not in names:
            names[names.index(old)] = new
    return df.toDF(*names)


def first_column(df: DataFrame, candidates: list[str], what: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}")


def number(c: Column) -> Column:
    """Tolerant number; NaN counts as missing."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def repaired_probability(c: Column) -> Column:
    """Percentages to shares, clamped to [0, 1], unreadable to 0."""
    value = number(c)
    share = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))


def resolved_label(df: DataFrame) -> Column:
    """true_label, else is_anomaly_pred, else the raw probability against the cut, else 0."""
    for name in ("true_label", "is_anomaly_pred"):
        if name in df.columns:
            return F.coalesce(number(F.col(name)).cast("int"), F.lit(0))
    if "prob_anomaly" in df.columns:
        return F.coalesce((number(F.col("prob_anomaly")) >= LABEL_CUT).cast("int"), F.lit(0))
    return F.lit(0)


def upload_id(at: Column, message: Column) -> Column:
    """Stable identity of an uploaded row."""
    return F.concat_ws("_", text.iso(at), F.substring(F.sha2(F.concat_ws("|", text.iso(at), message), 256), 1, 16))


def case_id(at: Column, host: Column, service: Column, severity: Column, source: Column, message: Column) -> Column:
    return F.concat_ws(
        "|", text.iso(at), F.coalesce(host, F.lit("")), F.coalesce(service, F.lit("")),
        F.coalesce(severity, F.lit("LOW")), F.coalesce(source, F.lit("live")), text.strip(F.coalesce(message, F.lit(""))))


def normalize_upload(df: DataFrame, source_tag: str, ingest_ts: Column) -> DataFrame:
    """Uploaded rows in the canonical columns, stamped with the ingest time.

    For a tag that is not an upload the row's own times are kept where readable.
    """
    df = rename_headers(df)
    for name in ("detected_at", "timestamp", "host", "service", "message"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    label = resolved_label(df)
    if "prob_anomaly" in df.columns:
        prob = repaired_probability(F.col("prob_anomaly"))
    else:
        prob = F.when(label == 1, PROB_IF_POSITIVE).otherwise(0.0)
    if source_tag.startswith("upload"):
        at = seen = ingest_ts
    else:
        at = F.coalesce(text.utc(F.col("timestamp")), ingest_ts)
        seen = F.coalesce(text.utc(F.col("detected_at")), ingest_ts)
    extra = [c for c in df.columns if c not in (
        "anomaly_id", "detected_at", "timestamp", "host", "service", "message", "prob_anomaly",
        "is_anomaly_pred", "true_label", "model", "pid", "source")]
    return df.select(
        *extra,
        upload_id(at, F.col("message")).alias("anomaly_id"),
        seen.alias("detected_at"), at.alias("timestamp"), "host", "service", "message",
        prob.alias("prob_anomaly"), label.alias("is_anomaly_pred"),
        (F.col("model") if "model" in df.columns else F.lit("upload")).alias("model"),
        (F.coalesce(number(F.col("pid")).cast("int"), F.lit(-1)) if "pid" in df.columns else F.lit(-1)).alias("pid"),
        F.lit(source_tag).alias("source"),
    )


def repair_stored(df: DataFrame, as_of: Column, message_limit: int | None = None) -> DataFrame:
    """Clean an all-string copy of the anomaly table; messages are whole unless ``message_limit`` cuts them.

    Repeated header rows, blank rows and rows without message and host go;
    missing columns come back with defaults; times, numbers and messages are
    made readable. Callers sort by detected_at when they need the order.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    present = [c for c in df.columns if c in STORED_FIELDS]
    cells = [F.coalesce(F.col(name), F.lit("")) for name in present]
    header = F.concat_ws("\x01", *[F.trim(c) for c in cells]) == "\x01".join(present)
    blank = F.concat_ws("", *cells) == ""

    def raw(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in present else F.lit("")

    message = text.collapse(raw("message"))
    message = text.truncate(message, message_limit) if message_limit else message
    at = text.utc(raw("timestamp"))
    seen = F.coalesce(text.utc(raw("detected_at")), at, as_of)
    extra = [c for c in df.columns if c not in STORED_FIELDS]
    return (
        df.where(~header & ~blank)
        .select(
            *extra,
            at.alias("timestamp"), seen.alias("detected_at"),
            raw("host").alias("host"), raw("service").alias("service"), message.alias("message"),
            F.coalesce(number(raw("prob_anomaly")), F.lit(0.0)).alias("prob_anomaly"),
            F.coalesce(number(raw("is_anomaly_pred")).cast("int"), F.lit(0)).alias("is_anomaly_pred"),
            F.coalesce(number(raw("pid")).cast("int"), F.lit(-1)).alias("pid"),
            raw("model").alias("model"), raw("source").alias("source"),
            F.coalesce(F.nullif(raw("severity"), F.lit("")), F.lit("LOW")).alias("severity"),
            raw("matched_rule").alias("matched_rule"),
            number(raw("active_event_count")).cast("long").alias("active_event_count"),
            F.lower(raw("correlation_triggered")).isin("true", "1").alias("correlation_triggered"),
            raw("escalation_reason").alias("escalation_reason"),
        )
        .where(~((F.col("message") == "") & (text.strip(F.col("host")) == "")))
    )


def strict_record(df: DataFrame) -> DataFrame:
    """Write-side normalisation by field type; what cannot be read gets the type's default."""

    def raw(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit("")

    rules = {
        "prob_anomaly": lambda c: F.coalesce(number(c), F.lit(0.0)),
        "is_anomaly_pred": lambda c: F.coalesce(F.trim(c).try_cast("int"), F.lit(0)),
        "pid": lambda c: F.coalesce(F.trim(c).try_cast("int"), F.lit(-1)),
        "severity": lambda c: F.upper(F.coalesce(F.nullif(c, F.lit("")), F.lit("LOW"))),
    }
    extra = [c for c in df.columns if c not in STORED_FIELDS]
    fields = [f for f in STORED_FIELDS if f != "threat_score"]
    return df.select(*extra, *[
        rules.get(name, lambda c: F.coalesce(c, F.lit("")))(raw(name)).alias(name) for name in fields])


# What a missing canonical column is filled with.
COLUMN_DEFAULTS = {
    "host": "",
    "service": "",
    "message": "",
    "prob_anomaly": 0.0,
    "is_anomaly_pred": 0,
    "model": "upload",
    "pid": -1,
    "source": "upload",
    "severity": "LOW",
    "matched_rule": "",
    "active_event_count": 0,
    "correlation_triggered": False,
    "escalation_reason": "",
}


def fill_canonical(df: DataFrame) -> DataFrame:
    """All stored columns in order and type; missing ones get their default."""
    columns = []
    for field in ANOMALY_SCHEMA.fields:
        default = F.lit(COLUMN_DEFAULTS.get(field.name)).cast(field.dataType)
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            value = F.nullif(value, F.lit("")) if field.name == "severity" else value
            columns.append(F.coalesce(value, default).alias(field.name))
        else:
            columns.append(default.alias(field.name))
    return df.select(*columns)


def text_label(c: Column, positive: list[str] = POSITIVE_WORDS) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(*positive), F.lit(False)).cast("int")


def labelled_corpus(df: DataFrame, dataset: str, positive: list[str] = POSITIVE_WORDS) -> DataFrame:
    """(message, true_label, source_dataset) from whichever columns the table has."""
    message = first_column(df, MESSAGE_CANDIDATES, "message")
    label = first_column(df, LABEL_CANDIDATES, "label")
    kept = F.col(label).cast("int") if dict(df.dtypes)[label] in ("int", "bigint") else text_label(F.col(label), positive)
    return df.select(F.col(message).cast("string").alias("message"), kept.alias("true_label"), F.lit(dataset).alias("source_dataset"))


def numbered(df: DataFrame, order: str, name: str = "timestamp") -> DataFrame:
    """0-based position by ``order``, without moving all rows to one task."""
    ranked = running_totals(ranged(df, [], order), [], [F.col(order)], {name: F.lit(1)}, F.col("_range")).drop("_range")
    return ranked.withColumn(name, F.col(name) - 1)


def display_time(c: Column, zone: str) -> Column:
    """UTC clock time shown in UTC or IST."""
    if zone == "UTC":
        return c
    if zone == "IST":
        return c + F.expr("INTERVAL '05:30' HOUR TO MINUTE")
    raise ValueError(f"unknown zone {zone}")


def json_text(c: Column, kind: str) -> Column:
    """Value as text for JSON; missing values become empty text."""
    if kind == "timestamp":
        return F.coalesce(text.iso(c), F.lit(""))
    if kind == "number":
        return F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))
