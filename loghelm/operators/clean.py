"""Row filters and message cleaning on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text


def split_vector_like(df: DataFrame, column: str = "message") -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows whose message is a dumped vector go to quarantine."""
    bad = F.coalesce(text.vector_like(text.text_or_empty(F.col(column))), F.lit(False))
    return df.where(~bad), df.where(bad)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: NULL count of every column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def has_text(message: Column) -> Column:
    """False for empty text and for the literal ``nan``."""
    folded = F.lower(text.strip(text.text_or_empty(message)))
    return ~folded.isin("", "nan")


def folded_message(df: DataFrame, column: str = "message") -> DataFrame:
    return df.withColumn(column, text.fold(F.col(column)))
