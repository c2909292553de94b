"""Filtered lists, counters and reports over the anomaly table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import scoring, text
from loghelm.operators.ranking import running_totals

DEFAULT_LIMIT = 200
TOP_ROWS = 5
# What an analyst may set, and the time spans that are counted.
VALID_STATUS = ["acknowledged", "closed", "false_positive"]
SPANS = {"last_10_minutes": 10, "last_1_hour": 60, "last_24_hours": 24 * 60}
# Banner levels as (level, at least this many, or this maximum in percent).
CRITICAL_COUNT, CRITICAL_MAX = 30, 98
HIGH_COUNT, HIGH_MAX = 5, 85
ELEVATED_COUNT, ELEVATED_MAX = 3, 60
BANNER_MAX = 100


def _instant(value: str | None) -> Column | None:
    """Bound of a time filter; an unreadable one is no bound."""
    if not value:
        return None
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        at = at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    except ValueError:
        return None
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def canonical_source(c: Column) -> Column:
    name = F.lower(text.strip(F.coalesce(c, F.lit(""))))
    return F.when(name == "uploads", "upload").otherwise(name)


def filter_anomalies(df: DataFrame, source: str | None = None, service: str | None = None, host: str | None = None,
                     start: str | None = None, end: str | None = None) -> DataFrame:
    """Optional filters; text compares without case, time bounds are inclusive."""
    wanted = (source or "").strip().lower()
    wanted = "upload" if wanted == "uploads" else wanted
    if wanted and wanted != "all":
        df = df.where(canonical_source(F.col("source")) == wanted)
    if service and service.strip():
        df = df.where(F.lower(text.strip(F.col("service"))) == service.strip().lower())
    if host and host.strip():
        df = df.where(F.lower(text.strip(F.col("host"))) == host.strip().lower())
    lower, upper = _instant(start), _instant(end)
    if lower is not None:
        df = df.where(F.col("detected_at") >= lower)
    if upper is not None:
        df = df.where(F.col("detected_at") <= upper)
    return df


def true_anomalies(df: DataFrame) -> DataFrame:
    return df.where((F.col("is_anomaly_pred") == 1) & F.col("detected_at").isNotNull())


def list_anomalies(df: DataFrame, limit: int = DEFAULT_LIMIT, tie: str | None = None, **filters) -> DataFrame:
    """Newest first; a limit of 0 or less lists all."""
    out = filter_anomalies(true_anomalies(df), **filters)
    out = out.orderBy(F.desc("detected_at"), *([F.desc(tie)] if tie else []))
    return out.limit(limit) if limit > 0 else out


def source_mode(df: DataFrame, mode: str = "live") -> DataFrame:
    mode = (mode or "all").lower()
    mode = "upload" if mode == "uploads" else mode
    if mode not in ("live", "upload"):
        return df
    name = F.when(F.coalesce(text.strip(F.col("source")), F.lit("")) == "", "live").otherwise(canonical_source(F.col("source")))
    return df.where(name == mode)


def severity_filter(df: DataFrame, level: str = "ALL") -> DataFrame:
    return df if level == "ALL" else df.where(F.upper(F.coalesce("severity", F.lit(""))) == level)


def counters(df: DataFrame, as_of: Column) -> DataFrame:
    """total and the counts of the last 10 minutes, hour and day up to ``as_of``."""
    spans = [
        F.count_if(F.col("detected_at") >= as_of - F.expr(f"INTERVAL '{minutes}' MINUTE")).alias(name)
        for name, minutes in SPANS.items()
    ]
    return df.agg(F.count(F.lit(1)).alias("total"), *spans)


def by_service(df: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(text.strip(F.col("service")), F.lit("")), F.lit("unknown"))
    return df.groupBy(name.alias("service")).agg(F.count(F.lit(1)).alias("anomalies")).orderBy(F.desc("anomalies"), "service")


def stats(df: DataFrame, catalogue: DataFrame, as_of: Column) -> DataFrame:
    """(section, name, value) rows: counters, data sets, counts by service."""
    counted = counters(df, as_of)
    wide = counted.select(F.expr("stack({}, {}) AS (name, value)".format(
        len(counted.columns), ", ".join(f"'{c}', {c}" for c in counted.columns))))
    sets = catalogue.agg(F.count(F.lit(1)).alias("value")).select(F.lit("datasets_analyzed").alias("name"), "value")
    services = by_service(df).select(F.lit("by_service").alias("section"), F.col("service").alias("name"), F.col("anomalies").alias("value"))
    return wide.unionByName(sets).select(F.lit("counts").alias("section"), "name", "value").unionByName(services)


def hourly_activity(df: DataFrame, as_of: Column, shift_minutes: int = 0) -> DataFrame:
    """24 hours up to ``as_of`` by hour of the day, oldest hour first, zero-filled."""
    shift = F.expr(f"INTERVAL '{shift_minutes}' MINUTE")
    now = F.date_trunc("minute", as_of).cast("timestamp_ntz")
    hour = F.date_format(F.col("detected_at") + shift, "HH:'00'")
    filled = (
        df.where((F.col("detected_at") >= now - F.expr("INTERVAL '1440' MINUTE")) & (F.col("detected_at") <= now))
        .groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("anomalies"))
    )
    positions = df.sparkSession.range(24).select(
        F.col("id").alias("position"),
        F.date_format(now + shift - F.make_dt_interval(F.lit(0), (F.lit(23) - F.col("id")).cast("int")), "HH:'00'").alias("hour"))
    return positions.join(filled, "hour", "left").select(
        "position", "hour", F.coalesce("anomalies", F.lit(0)).alias("anomalies")).orderBy("position")


def severity_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(scoring.severity_rank(F.col("severity"))), F.desc("detected_at"))


def severity_positions(df: DataFrame, tie: str) -> DataFrame:
    """Add ``position`` in severity order: highest severity, newest, then ``tie``. Rows are numbered by severity and day."""
    rank = scoring.severity_rank(F.col("severity"))
    day = F.coalesce(F.unix_date(F.to_date("detected_at")), F.lit(0))
    placed = df.withColumn("_rank", rank)
    bucket = -(F.col("_rank") * 10_000_000 + day).cast("long")
    return running_totals(
        placed, [], [F.desc("_rank"), F.desc("detected_at"), F.col(tie)], {"position": F.lit(1)}, bucket).drop("_rank")


def threat_order(df: DataFrame, limit: int = TOP_ROWS, tie: str | None = None) -> DataFrame:
    out = df.orderBy(F.desc(F.coalesce("threat_score", F.lit(0))), F.desc("timestamp"), *([F.desc(tie)] if tie else []))
    return out.limit(limit) if limit > 0 else out


def severity_counts(df: DataFrame) -> DataFrame:
    level = F.upper(F.coalesce("severity", F.lit("LOW")))
    return df.agg(
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("medium"),
        F.count_if(~level.isin("HIGH", "MEDIUM")).alias("low"),
    )


def threat_level(df: DataFrame) -> DataFrame:
    """One row: overall level and whether the critical banner shows."""
    level = F.upper(F.coalesce("severity", F.lit("LOW")))
    agg = df.agg(
        F.count_if(level == "HIGH").alias("high"), F.count_if(level == "MEDIUM").alias("medium"),
        F.coalesce(F.max(F.col("prob_anomaly") * 100), F.lit(0.0)).alias("max_threat"))
    high, medium, top = F.col("high"), F.col("medium"), F.col("max_threat")
    return agg.select(
        "high", "medium", F.round("max_threat", 6).alias("max_threat"),
        F.when((high >= CRITICAL_COUNT) & (top >= CRITICAL_MAX), "CRITICAL")
        .when((high >= HIGH_COUNT) | (top >= HIGH_MAX), "HIGH")
        .when((medium >= ELEVATED_COUNT) | (top >= ELEVATED_MAX), "ELEVATED")
        .otherwise("NORMAL").alias("level"),
        (top >= BANNER_MAX).alias("banner"),
    )


def service_summary(df: DataFrame) -> DataFrame:
    """count, mean probability and latest time of every service."""
    return df.groupBy("service").agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.round(F.avg("prob_anomaly"), 6).alias("avg_probability"),
        F.max(F.coalesce("detected_at", "timestamp")).alias("latest"),
    )


def latest_actions(actions: DataFrame) -> DataFrame:
    """Last valid action per anomaly."""
    return actions.where(F.col("status").isin(*VALID_STATUS) & F.col("anomaly_id").isNotNull()).groupBy("anomaly_id").agg(
        F.max_by(F.struct("status", "comment", "action_time"), F.struct("action_time", "status")).alias("a")
    ).select("anomaly_id", "a.*")


def case_status(anomalies: DataFrame, actions: DataFrame, id_col: str) -> DataFrame:
    """Add status (upper case, NEW without an action), comment and action_time."""
    last = latest_actions(actions).withColumnRenamed("anomaly_id", id_col)
    return (
        anomalies.join(last, id_col, "left")
        .withColumn("status", F.upper(F.coalesce("status", F.lit("new"))))
        .withColumn("comment", F.coalesce("comment", F.lit("")))
    )


def latest_run(history: DataFrame) -> DataFrame:
    """The newest retraining run, its time shown as yyyy-MM-dd HH:mm."""
    t = F.col("timestamp")
    shown = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2), F.lit(" "),
                     F.substring(t, 10, 2), F.lit(":"), F.substring(t, 12, 2))
    return history.orderBy(F.desc("timestamp")).limit(1).withColumn(
        "shown_time", F.when(F.length(t) >= 15, shown).otherwise("--"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """count and share of every value; the total comes from the few counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    from pyspark.sql import Window as W
    return counts.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(W.partitionBy(F.lit(1))), 4))


def label_crosstab(df: DataFrame, dataset: str, label: str) -> DataFrame:
    return (
        df.groupBy(dataset).pivot(label, [0, 1]).agg(F.count(F.lit(1))).na.fill(0, ["0", "1"])
        .withColumnsRenamed({"0": "label_0", "1": "label_1"})
    )


def dataset_summary(df: DataFrame, dataset: str, label: str) -> DataFrame:
    """Totals and anomaly rate per data set, and a combined row."""
    return (
        df.rollup(dataset).agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(F.col(label) == 0).alias("normal_records"),
            F.count_if(F.col(label) == 1).alias("anomalous_records"))
        .withColumn("dataset", F.coalesce(F.col(dataset), F.lit("combined")))
        .withColumn("anomaly_rate", F.round(F.col("anomalous_records") / F.col("total_records") * 100, 2))
        .select("dataset", "total_records", "normal_records", "anomalous_records", "anomaly_rate")
    )


def audit(df: DataFrame, label: str, time: str) -> DataFrame:
    """One row: rows, columns, missing cells, classes and time range, in one pass."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"), missing.alias("missing_cells"),
        F.count_if(F.col(label) == 1).alias("anomalies"), F.count_if(F.col(label) == 0).alias("normals"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def longest_messages(df: DataFrame, id_col: str, message: str = "message", k: int = 5, preview: int = 1000) -> DataFrame:
    return df.select(id_col, F.char_length(message).cast("long").alias("message_length"), F.substring(message, 1, preview).alias("preview")
                     ).orderBy(F.desc("message_length"), id_col).limit(k)


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: repeatable and portable."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)
