"""Explanation and prioritising of anomalies by rule tables."""
