"""Records not seen lately, with a memory of keys that is bounded by time.

Each key is a state entry of its own that goes once the watermark has passed its time
to live, so the memory holds the keys of that time and no more, on the executors' disks.
A job that starts without a checkpoint takes the keys of the stored table for seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loghelm.operators.dedup import row_key


class SeenKeys(StatefulProcessor):
    """Per key: the first row by ``order`` passes, later ones do not until the key's time is over."""

    def __init__(self, order: str, keep_seconds: int):
        self.order, self.keep = order, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def _remember(self, at_ms: int) -> None:
        self.seen.update((at_ms + self.keep,))
        self.handle.registerTimer(at_ms + self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, first = self.seen.get()[0] if self.seen.exists() else None, None
        for pdf in rows:
            pdf = pdf if until is None else pdf[pdf["at_ms"] >= until]  # the timer may not have fired yet
            if len(pdf):
                least = pdf.nsmallest(1, self.order)
                first = least if first is None or least[self.order].iloc[0] < first[self.order].iloc[0] else first
        if first is not None:
            self._remember(int(first["at_ms"].iloc[0]))
            yield first.drop(columns=["row_key", "at_ms", "event_time"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self._remember(int(initialState["at_ms"].iloc[0]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter([])


def _keyed(df: DataFrame, ts_col: str) -> DataFrame:
    at = F.col(ts_col).cast("timestamp")
    return df.withColumns({"row_key": row_key(F.col("host"), F.col("service"), F.col("pid"), F.col("message")),
                           "event_time": at, "at_ms": F.unix_millis(at)})


def new_records(df: DataFrame, stored: DataFrame | None, order: str, keep_seconds: int = 30 * 86_400,
                delay: str = "1 hour", ts_col: str = "timestamp") -> DataFrame:
    """Rows of a stream (host, service, pid, message, time, ...) whose key was not seen for ``keep_seconds`` of event time.

    ``stored`` is the table written so far, read by a job's first batch only; None if there is none. Of rows of one
    batch the least by ``order`` passes. Rows later than ``delay``, or without a time, are left out; columns stay.
    """
    start = None
    if stored is not None:
        start = _keyed(stored, ts_col).where("at_ms IS NOT NULL").groupBy("row_key").agg(F.max("at_ms").alias("at_ms")).groupBy("row_key")
    timed = _keyed(df, ts_col).withWatermark("event_time", delay).where("event_time IS NOT NULL")
    return timed.groupBy("row_key").transformWithStateInPandas(
        SeenKeys(order, keep_seconds), df.schema, "Append", "EventTime", initialState=start)
