"""Loads every family of queries."""

from loghelm.plans import (  # noqa: F401
    clean_plans,
    detect_plans,
    evaluate_plans,
    feature_plans,
    model_plans,
    parse_plans,
    query_plans,
    stream_plans,
    triage_plans,
)

FLAGSHIP = "live_detection"
