"""Repeat suppression and sliding counts as stateful operators on event time.

A chain of repeats is keyed by its signature, a count by (rule, source, slice of time), so
neither holds a source's whole delay in one place. Signatures, and slices, are dealt to a
fixed number of groups by hash, as a call for each of them would cost far more than its events
do. A group's events wait in small chunks, one map entry each, that end where the time from
the first event grows eightfold; one timer a group, at the first event that is due, takes out
all that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loghelm.operators.correlate import MICROS, CorrelationRule

KEPT = "rule string, ip string, us long, id long, payload string, released timestamp"
COUNTED = "id long, rule string, active_event_count long, payload string"
CHUNK_ROWS = 5_000
WINDOWS_A_SLICE = 4
GROUPS = 256


def hold_micros(rule: CorrelationRule) -> int:
    """Length of the slices in which a chain's events wait: the gap, between a second and a minute."""
    return min(max(rule.dedup_seconds, 1), 60) * MICROS


def slice_micros(rule: CorrelationRule) -> int:
    """Length of the slices that events are counted in."""
    return WINDOWS_A_SLICE * max(rule.window_seconds, 1) * MICROS


class _Waiting(StatefulProcessor):
    """Rows of a group wait until the watermark has passed their ``due`` instant."""

    columns: dict[str, str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in {"due": "long", **self.columns}.items())
        self.chunks = handle.getMapState("chunks", "due long, number long", arrays)
        self.made = handle.getValueState("made", "chunks long")
        self.timer = handle.getValueState("timer", "ms long")

    def _keep(self, rows: pd.DataFrame, hold: int) -> None:
        """Chunks by due instant; each covers eight times the time of the one before, so few rows are written again."""
        rows = rows.sort_values("due", kind="stable")
        due = rows["due"].to_numpy()
        span = np.floor(np.log2((due - due[0]) // hold + 1) / 3)
        ends = np.append(np.flatnonzero(np.diff(span)) + 1, len(rows))
        number, begin = self.made.get()[0] if self.made.exists() else 0, 0
        for end in ends:
            for at in range(begin, end, CHUNK_ROWS):
                some = rows.iloc[at:min(at + CHUNK_ROWS, end)]
                self.chunks.updateValue((int(some["due"].iloc[0]), number), tuple(some[c].tolist() for c in ("due", *self.columns)))
                number += 1
            begin = end
        self.made.update((number,))

    def _wake(self, ms: int) -> None:
        """One timer waits, the earliest."""
        if self.timer.exists():
            (before,) = self.timer.get()
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.timer.update((ms,))
        self.handle.registerTimer(ms)

    def _wait(self, rows: Iterator[pd.DataFrame], hold: int) -> None:
        for pdf in rows:
            if len(pdf):
                self._keep(pdf, hold)
                self._wake(int(pdf["due"].min()) // 1000)

    def _take(self, upto: int, hold: int) -> pd.DataFrame:
        """All rows due, in no order; the next timer is set."""
        self.timer.clear()
        taken, left = [], []
        for due, number in [k for k in self.chunks.keys() if k[0] <= upto]:
            rows = pd.DataFrame(dict(zip(("due", *self.columns), self.chunks.getValue((due, number)))))
            self.chunks.removeKey((due, number))
            passed = (rows["due"] <= upto).to_numpy()
            taken.append(rows[passed])
            left.append(rows[~passed])
        left = [rows for rows in left if len(rows)]
        if left:
            self._keep(pd.concat(left, ignore_index=True), hold)
        first = min((due for due, _ in self.chunks.keys()), default=None)
        if first is not None:
            self._wake(first // 1000)
        return pd.concat(taken, ignore_index=True) if taken else pd.DataFrame(columns=["due", *self.columns])


def _passed(timerValues, expiredTimerInfo) -> int:
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000


class RepeatChain(_Waiting):
    """Per (ip, sig) of a group of one rule: an event stays if the last one that stayed lies more than the gap back."""

    columns = {"ip": "string", "sig": "string", "us": "long", "id": "long", "payload": "string"}

    def __init__(self, rules: list[CorrelationRule]):
        self.rules = {r.name: (r.dedup_seconds * MICROS, hold_micros(r)) for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ip array<string>, sig array<string>, us array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, hold = self.rules[key[0]]
        self._wait((pdf.assign(due=(pdf["us"] // hold + 1) * hold) for pdf in rows), hold)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gap, hold = self.rules[key[0]]
        upto = _passed(timerValues, expiredTimerInfo)
        ips, sigs, times = self.last.get() if self.last.exists() else ([], [], [])
        last = dict(zip(zip(ips, sigs), times))
        # of events at one instant the one with the smallest id stays, whatever came before
        events = self._take(upto, hold).sort_values(["us", "id"])
        stays = np.zeros(len(events), dtype=bool)
        for i, (ip, sig, us) in enumerate(zip(events["ip"], events["sig"], events["us"])):
            before = last.get((ip, sig))
            if before is None or us > before + gap:
                last[ip, sig] = us
                stays[i] = True
        # of a signature whose last event lies further back, nothing that comes can still be a repeat
        open_ = [(ip, sig, us) for (ip, sig), us in last.items() if us + gap >= upto]
        if open_:
            self.last.update(tuple(map(list, zip(*open_))))
            self._wake(max(us for _, _, us in open_) // 1000 + gap // 1000 + 1)
        elif ips:
            self.last.clear()
        if stays.any():
            kept = events[stays]
            yield pd.DataFrame({"rule": key[0], "ip": kept["ip"], "us": kept["us"], "id": kept["id"], "payload": kept["payload"],
                                "released": pd.to_datetime(kept["due"], unit="us", utc=True)})


class SlidingCount(_Waiting):
    """Per (ip, slice) of a group of one rule: events of the window that ends with each of the slice's own events."""

    columns = {"ip": "string", "slice": "long", "us": "long", "id": "long", "own": "boolean", "payload": "string"}

    def __init__(self, rules: list[CorrelationRule]):
        self.rules = {r.name: (r.window_seconds * MICROS, slice_micros(r), hold_micros(r)) for r in rules}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, size, hold = self.rules[key[0]]
        # the last of a slice's events is released when its chain's slice has ended
        self._wait((pdf.assign(due=(pdf["slice"] + 1) * size + hold) for pdf in rows), size)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, size, _ = self.rules[key[0]]
        events = self._take(_passed(timerValues, expiredTimerInfo), size)
        if events.empty:
            return
        events["ip"] = pd.factorize(events["ip"], use_na_sentinel=False)[0]
        events = events.sort_values(["ip", "slice", "us", "id"])
        ip, at = events["ip"].to_numpy(), events["slice"].to_numpy()
        fresh = np.ones(len(events), dtype=bool)
        fresh[1:] = (ip[1:] != ip[:-1]) | (at[1:] != at[:-1])
        # slices laid end to end on one line, each begun by the window before it
        line = (np.cumsum(fresh) - 1) * (size + 2 * window + 1) + (events["us"].to_numpy() - at * size) + 2 * window
        count = np.arange(1, len(events) + 1) - np.searchsorted(line, line - window, "left")
        own = events["own"].to_numpy(dtype=bool)
        if own.any():
            mine = events[own]
            yield pd.DataFrame({"id": mine["id"], "rule": key[0], "active_event_count": count[own], "payload": mine["payload"]})


def _by_rule(rules: list[CorrelationRule], value) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(value(r))) for r in rules])


def counted_events(matched: DataFrame, rules: list[CorrelationRule], groups: int = GROUPS) -> DataFrame:
    """id, rule, active_event_count, payload of the events that stay.

    Input: rule, ip, sig, us, id, payload, and a column with the watermark. An event of a slice's last window
    goes to the next slice as well, to be counted there and not given out. A job that goes on from a checkpoint
    needs the number of ``groups`` it was begun with.
    """
    group = lambda *of: F.pmod(F.xxhash64(*of), F.lit(groups)).cast("int").alias("group")
    chained = matched.withColumn("group", group("ip", "sig")).groupBy("rule", "group").transformWithStateInPandas(
        RepeatChain(rules), KEPT, "Append", "EventTime", eventTimeColumnName="released")
    size, window = _by_rule(rules, slice_micros), _by_rule(rules, lambda r: r.window_seconds * MICROS)
    own, later = F.floor(F.col("us") / size).cast("long"), F.floor((F.col("us") + window) / size).cast("long")
    copies = F.array(
        F.struct(own.alias("slice"), F.lit(True).alias("own"), F.col("payload").alias("shown")),
        F.when(later != own, F.struct(later.alias("slice"), F.lit(False).alias("own"), F.lit(None).cast("string").alias("shown"))))
    dealt = chained.withColumn("copy", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select(
        "rule", "ip", "copy.slice", "us", "id", "copy.own", F.col("copy.shown").alias("payload"), "released")
    return dealt.withColumn("group", group("ip", "slice")).groupBy("rule", "group").transformWithStateInPandas(
        SlidingCount(rules), COUNTED, "Append", "EventTime")
