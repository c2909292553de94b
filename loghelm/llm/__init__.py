"""Operators for preparing training data, their queries and the SQL twins."""
