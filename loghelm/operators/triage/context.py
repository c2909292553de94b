"""Context columns the rule conditions read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.text import contains_any

# Phrases behind each context flag.
FLAG_WORDS = {
    "auth": ["failed password", "authentication failed", "invalid user"],
    "priv": ["sudo", "root", "privilege escalation"],
    "recon": ["scan", "nmap", "recon"],
    "pers": ["cron", "scheduled"],
    "exec": ["bash", "powershell", "cmd", "script"],
}


def with_context(df: DataFrame) -> DataFrame:
    """Add the x_ columns; each is computed once, before any rule reads it."""
    have = set(df.columns)

    def col(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    base = df.withColumns({
        "x_msg": F.lower(col("message", "")),
        "x_service": F.lower(col("service", "")),
        "x_sev": F.upper(col("severity", "LOW")),
        "x_status": F.upper(col("status", "")),
        "x_prob": col("prob_anomaly", 0.0).cast("double"),
        "x_corr": col("correlation_triggered", False),
        "x_n": col("active_event_count", 0).cast("long"),
        "x_reason": col("escalation_reason", ""),
        "x_threat": col("threat_score", 0).cast("int"),
    })
    flags = {f"x_{name}": contains_any(F.col("x_msg"), words) for name, words in FLAG_WORDS.items()}
    return base.withColumns({
        **flags, "x_crit": F.col("x_sev") == "CRITICAL", "x_hs": F.col("x_sev").isin("HIGH", "CRITICAL")})


def without_context(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("x_")])
