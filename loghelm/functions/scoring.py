"""Scores, thresholds and severities as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghelm.functions import text

# Keyword score.
SCORE_KEYWORDS = [
    "failed", "error", "unauthorized", "denied", "timeout",
    "segfault", "panic", "refused", "invalid",
]
SCORE_BASE = 0.40
SCORE_STEP = 0.08
SCORE_BONUS_PHRASE = "failed password"
SCORE_BONUS = 0.30
SCORE_CAP = 0.99

# Decision thresholds by service.
SERVICE_THRESHOLDS = {
    "sshd": 0.70,
    "CRON": 0.80,
    "sendmail": 0.85,
    "rtkit-daemon": 0.90,
}
DEFAULT_THRESHOLD = 0.65
JSON_THRESHOLD = 0.60

# Fixed values: (HIGH from, MEDIUM from) of each severity scale.
SEVERITY_SCALES = {
    "live": (0.75, 0.55),
    "tail": (0.85, 0.65),
    "upload": (0.80, 0.60),
    "dashboard": (0.8, 0.6),
}
THREAT_SCORES = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50}
THREAT_SCORE_REST = 25
SEVERITY_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def keyword_score(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    hits = text.count_present(m, SCORE_KEYWORDS)
    bonus = F.when(m.contains(SCORE_BONUS_PHRASE), SCORE_BONUS).otherwise(0.0)
    return F.least(F.lit(SCORE_CAP), F.lit(SCORE_BASE) + F.lit(SCORE_STEP) * hits + bonus)


def service_threshold(service: Column, strict_reference: bool = False) -> Column:
    """Threshold of a canonical (lower-case) service.

    ``strict_reference`` compares with the mixed-case key as stored, so cron
    rows fall to the default.
    """
    out = F.lit(DEFAULT_THRESHOLD)
    for name, cut in SERVICE_THRESHOLDS.items():
        out = F.when(service == (name if strict_reference else name.lower()), cut).otherwise(out)
    return out


def severity(prob: Column, scale: str = "live") -> Column:
    high, medium = SEVERITY_SCALES[scale]
    return F.when(prob >= high, "HIGH").when(prob >= medium, "MEDIUM").otherwise("LOW")


def threat_score(sev: Column) -> Column:
    out = F.lit(THREAT_SCORE_REST)
    for name, score in THREAT_SCORES.items():
        out = F.when(sev == name, score).otherwise(out)
    return out


def severity_rank(sev: Column) -> Column:
    folded = F.upper(F.coalesce(sev, F.lit("LOW")))
    out = F.lit(0)
    for name, rank in SEVERITY_ORDER.items():
        out = F.when(folded == name, rank).otherwise(out)
    return out
