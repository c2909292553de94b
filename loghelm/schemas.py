"""Fixed schemas of the stored tables."""

from pyspark.sql import types as T

# Canonical anomaly record, in storage order.
CANONICAL_FIELDS = [
    "timestamp",
    "detected_at",
    "host",
    "service",
    "message",
    "prob_anomaly",
    "is_anomaly_pred",
    "pid",
    "model",
    "source",
    "severity",
    "matched_rule",
    "active_event_count",
    "correlation_triggered",
    "escalation_reason",
]

_KINDS = {
    "timestamp": T.TimestampNTZType(),
    "detected_at": T.TimestampNTZType(),
    "prob_anomaly": T.DoubleType(),
    "is_anomaly_pred": T.IntegerType(),
    "pid": T.IntegerType(),
    "active_event_count": T.LongType(),
    "correlation_triggered": T.BooleanType(),
    "threat_score": T.IntegerType(),
}

# threat_score is a 16th column: the lists sort by it, so it has to be stored.
STORED_FIELDS = [*CANONICAL_FIELDS, "threat_score"]

ANOMALY_SCHEMA = T.StructType(
    [T.StructField(name, _KINDS.get(name, T.StringType())) for name in STORED_FIELDS]
)

PARSED_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("host", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("message", T.StringType()),
])

LABELLED_SCHEMA = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("true_label", T.IntegerType()),
    T.StructField("source_dataset", T.StringType()),
])

RETRAIN_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("dataset_size", T.LongType()),
    T.StructField("feedback_samples", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("best_threshold", T.DoubleType()),
    T.StructField("best_precision", T.DoubleType()),
    T.StructField("best_recall", T.DoubleType()),
    T.StructField("best_f1", T.DoubleType()),
    T.StructField("deployment_status", T.StringType()),
])
