"""Repeated-event correlation: greedy repeat suppression and sliding counts.

Both operators work on narrow rows (key, instant, id) cut into time blocks, so
a source that sends a third of all events is spread over as many tasks as its
events span blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators.parse import source_ip
from loghelm.operators.ranking import running_totals

MICROS = 1_000_000
NONE = -(1 << 62)  # no accepted event
FAN_OUT = 1024  # blocks to a range
MIN_MICROS, MAX_MICROS = -62_135_596_800 * MICROS, 253_402_300_800 * MICROS  # years 1 to 9999


@dataclass(frozen=True)
class CorrelationRule:
    """Ordered patterns, the repeat gap, the counting window and the escalation."""

    name: str
    patterns: tuple[str, ...]
    window_seconds: int = 60
    dedup_seconds: int = 15
    correlation_threshold: int = 3
    severity: str = "HIGH"
    critical_count: int = 5
    block_seconds: int = field(default=0)

    @property
    def block_micros(self) -> int:
        seconds = self.block_seconds or 8 * max(self.window_seconds, self.dedup_seconds, 1)
        return seconds * MICROS


# The rule in force and the two escalation texts.
SSH_BRUTEFORCE = CorrelationRule(
    name="ssh_bruteforce",
    window_seconds=60,
    correlation_threshold=3,
    dedup_seconds=15,
    severity="HIGH",
    patterns=(
        "ssh",
        "failed password",
        "authentication failed",
        "brute force",
    ),
)
ESCALATED = "Repeated behavioral correlation detected"
NOT_ESCALATED = "ML semantic anomaly"


def matched_pattern(message: Column, rule: CorrelationRule) -> Column:
    """First pattern of the rule found in the lower-cased message, else NULL."""
    folded = F.lower(message)
    return F.coalesce(*[F.when(folded.contains(p), p) for p in rule.patterns])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut batches of key-sorted rows so that no group spans two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = tuple(pdf[k].iloc[-1] for k in keys)
        same = np.ones(len(pdf), dtype=bool)
        for k, v in zip(keys, last):
            same &= (pdf[k] == v).to_numpy()
        cut = len(pdf) if not same.any() else int(np.argmax(same))
        if cut == 0 and held and all(held[-1][k].iloc[-1] == v for k, v in zip(keys, last)):
            held.append(pdf)
            continue
        done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        if not done.empty:
            yield done
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _chains(pdf: pd.DataFrame, block: int, gap: int):
    """Group starts, offsets in the block, and each event's next accepted event.

    ``follow`` holds, per event, the index of the first event of its group more
    than ``gap`` later, or the event itself when the group has none.
    """
    blocks = pdf["block"].to_numpy()
    sig = pdf["sig"].to_numpy()
    fresh = np.ones(len(pdf), dtype=bool)
    fresh[1:] = (blocks[1:] != blocks[:-1]) | (sig[1:] != sig[:-1])
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(pdf))
    offset = pdf["us"].to_numpy() - blocks * block
    line = group * (block + gap + 1) + offset
    nxt = np.searchsorted(line, line + gap, side="right")
    inside = nxt < ends[group]
    follow = np.where(inside, nxt, np.arange(len(pdf)))
    return group, starts, ends, offset, line, follow


def _summarise(block: int, gap: int):
    """Per block that events can reach into or out of: for every possible entry point, the last accepted event that reaches out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, ["sig", "block"]):
            group, starts, ends, offset, _, follow = _chains(pdf, block, gap)
            last = follow
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            index = np.arange(len(pdf))
            first = index == starts[group]
            before = np.where(first, -1, offset[np.maximum(index - 1, 0)])
            entry = first | (before < gap)
            tail = offset[last] >= block - gap
            exit_at = np.where(tail, pdf["us"].to_numpy()[last], NONE)
            linked = (offset[starts] < gap)[group] | tail
            changed = np.ones(len(pdf), dtype=bool)
            changed[1:] = first[1:] | (exit_at[1:] != exit_at[:-1])
            keep = entry & linked & changed
            out = pd.DataFrame({
                "sig": pdf["sig"].to_numpy()[keep], "block": pdf["block"].to_numpy()[keep],
                "above": before[keep], "exit_us": exit_at[keep]})
            yield out
            final = ends - 1
            none = final[offset[final] < gap]
            yield pd.DataFrame({
                "sig": pdf["sig"].to_numpy()[none], "block": pdf["block"].to_numpy()[none],
                "above": offset[none], "exit_us": np.full(len(none), NONE)})

    return run


class _Children:
    """Step functions of the children of ranges, one row a step, sorted by range, child and ``above``.

    A child's function takes the last event accepted before it and gives the last one accepted by its end: the exit of
    its last step whose ``above`` does not exceed the offset up to which that earlier event suppresses.
    """

    def __init__(self, pdf: pd.DataFrame, size: int, base: int, gap: int, fan_out: int):
        sig, group, child = pdf["sig"].to_numpy(), pdf["range"].to_numpy(), pdf["child"].to_numpy()
        fresh = np.ones(len(pdf), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (group[1:] != group[:-1])
        new = fresh.copy()
        new[1:] |= child[1:] != child[:-1]
        self.first = np.flatnonzero(new)  # first step of each child
        self.group = (np.cumsum(fresh) - 1)[self.first]
        self.child, self.range, self.sig = child[self.first], group[self.first], sig[self.first]
        self.place = self.child - self.range * fan_out
        self.groups = int(fresh.sum())
        self.leading = np.searchsorted(self.group, np.arange(self.groups))  # first child of each range
        self.rank = np.arange(len(self.first)) - self.leading[self.group]
        self.gap, self.start, self.width = gap, base + self.child * size, gap + 2  # an offset above lies below the gap
        self.above, self.exit = pdf["above"].to_numpy(), pdf["exit_us"].to_numpy()
        self.steps = (np.cumsum(new) - 1) * self.width + self.above + 1

    def limit(self, children: np.ndarray, carry: np.ndarray) -> np.ndarray:
        """Offset in each child up to which the event carried into it suppresses; -1 for none."""
        return np.where(carry == NONE, -1, np.maximum(carry + self.gap - self.start[children], -1))

    def apply(self, children: np.ndarray, limit: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.steps, children * self.width + limit + 1, side="right") - 1
        return self.exit[at]

    def following(self, rank: int) -> np.ndarray:
        """The children of this rank, at most one a range."""
        return np.flatnonzero(self.rank == rank)

    def adjoins(self, children: np.ndarray) -> np.ndarray:
        """Whether the child just before is there too; no event reaches over one that is not."""
        return (self.rank[children] > 0) & (self.child[children] == self.child[children - 1] + 1)


def _compose(size: int, base: int, gap: int, fan_out: int):
    """Step functions of ranges from those of their children: every entry of the first child is followed to the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, ["sig", "range"]):
            c = _Children(pdf, size, base, gap, fan_out)
            owner = np.repeat(np.arange(len(c.first)), np.diff(np.append(c.first, len(pdf))))
            # a range that lacks its first child has one entry only
            starts = (c.rank[owner] == 0) & ((c.place[owner] == 0) | (c.above == -1))
            group, above, exit_us = c.group[owner[starts]], c.above[starts], c.exit[starts]
            for rank in range(1, int(c.rank.max(initial=0)) + 1):
                children = c.following(rank)
                of = np.full(c.groups, -1)
                of[c.group[children]] = children
                at = np.flatnonzero(of[group] >= 0)
                here = of[group[at]]
                exit_us[at] = c.apply(here, c.limit(here, np.where(c.adjoins(here), exit_us[at], NONE)))
                same = np.zeros(len(group), dtype=bool)
                same[1:] = (group[1:] == group[:-1]) & (exit_us[1:] == exit_us[:-1])
                group, above, exit_us = group[~same], above[~same], exit_us[~same]
            last = np.append(c.leading[1:], len(c.first)) - 1
            exit_us = np.where(c.place[last][group] == fan_out - 1, exit_us, NONE)
            lead = c.leading[group]
            # a range that nothing reaches into or out of is as good as none
            linked = (c.place[lead] == 0) | (np.bincount(group[exit_us != NONE], minlength=c.groups)[group] > 0)
            yield pd.DataFrame({"sig": c.sig[lead], "block": c.range[lead], "above": above, "exit_us": exit_us})[linked]

    return run


def _hand_down(size: int, base: int, gap: int, fan_out: int):
    """For each child, the last event accepted before it, if it reaches in, from the one carried into its range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, ["sig", "range"]):
            c = _Children(pdf, size, base, gap, fan_out)
            carry = np.where(c.place == 0, pdf["carry_us"].to_numpy()[c.first], NONE)
            for rank in range(int(c.rank.max(initial=0)) + 1):
                children = c.following(rank)
                if rank:
                    before = children - 1
                    exit_us = c.apply(before, c.limit(before, carry[before]))
                    carry[children] = np.where(c.adjoins(children), exit_us, NONE)
                carry[children] = np.where(c.limit(children, carry[children]) >= 0, carry[children], NONE)
            known = carry != NONE
            yield pd.DataFrame({"sig": c.sig[known], "block": c.child[known], "carry_us": carry[known]})

    return run


def _carried(summary: DataFrame, gap: int, block: int) -> DataFrame:
    """(sig, block, carry_us): the last event accepted before each block, where it reaches into it.

    Blocks are joined to ranges, these to ranges of ranges, until one spans all times a timestamp can hold; each
    range is composed in one task whatever its signature, and carries are handed down the same way.
    """
    low, high = MIN_MICROS // block, MAX_MICROS // block
    schema, base = "sig binary, block long, above long, exit_us long", low * block
    levels: list[tuple[DataFrame, int]] = []
    size, spans, rows = block, high - low + 1, summary.withColumn("block", F.col("block") - low)
    while True:
        ranged = rows.select("sig", F.floor(F.col("block") / FAN_OUT).cast("long").alias("range"), F.col("block").alias("child"),
                             "above", "exit_us").repartition("sig", "range")
        levels.append((ranged, size))
        spans = -(-spans // FAN_OUT)
        if spans <= 1:
            break
        rows = ranged.sortWithinPartitions("sig", "range", "child", "above").mapInPandas(_compose(size, base, gap, FAN_OUT), schema)
        size *= FAN_OUT
    carries = None
    for ranged, size in reversed(levels):
        met = ranged.withColumn("carry_us", F.lit(NONE))
        if carries is not None:
            known = carries.select("sig", F.col("block").alias("range"), F.col("carry_us").alias("known")).hint("merge")
            met = ranged.join(known, ["sig", "range"], "left").withColumn("carry_us", F.coalesce("known", F.lit(NONE))).drop(
                "known").repartition("sig", "range")
        carries = met.sortWithinPartitions("sig", "range", "child", "above").mapInPandas(
            _hand_down(size, base, gap, FAN_OUT), "sig binary, block long, carry_us long")
    return carries.withColumn("block", F.col("block") + low)


def _mark(block: int, gap: int):
    """Follow each block's chain from its entry and keep the events on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, ["sig", "block"]):
            group, starts, ends, offset, line, follow = _chains(pdf, block, gap)
            carry = pdf["carry_us"].to_numpy(dtype="float64")[starts]
            base = pdf["block"].to_numpy()[starts] * block
            known = pdf["carry_us"].notna().to_numpy()[starts]
            carry_us = pdf["carry_us"].fillna(0).astype("int64").to_numpy()[starts]
            reach = np.where(known, carry_us + gap - base, -1)
            at = np.searchsorted(line, np.arange(len(starts)) * (block + gap + 1) + reach, side="right")
            at = at[at < ends] if len(at) else at
            accepted = np.zeros(len(pdf), dtype=bool)
            while len(at):
                accepted[at] = True
                ahead = follow[at]
                at = ahead[ahead != at]
            yield pdf.loc[accepted, ["sig", "rule", "ip", "us", "id"]]

    return run


def accepted_events(matched: DataFrame, gap_seconds: int, block_micros: int) -> DataFrame:
    """Events that survive greedy repeat suppression.

    Input: sig, rule, ip, us (microseconds), id. An event is dropped when the
    last accepted event of its signature lies at most ``gap_seconds`` back, so
    the answer depends on the whole chain. Each (signature, block) is solved on
    its own for every way the block before it may end. These answers are composed
    over ranges of blocks, and the true ends are handed back down, so no task
    walks a whole signature. Events without a time are on no chain and are left out.
    """
    gap = gap_seconds * MICROS
    if block_micros <= gap:
        raise ValueError("a block has to be longer than the gap")
    blocks = F.floor(F.col("us") / F.lit(block_micros)).cast("long")
    firsts = (
        matched.where(F.col("us").isNotNull()).groupBy("sig", "rule", "ip", "us").agg(F.min("id").alias("id"))
        .withColumn("block", blocks)
        .repartition("sig", "block")
    )
    # Both passes read all columns of ``firsts``, so Spark plans the shuffle once
    # and reuses it; a narrower first pass would scan the source a second time.
    summary = firsts.sortWithinPartitions("sig", "block", "us").mapInPandas(
        _summarise(block_micros, gap), "sig binary, block long, above long, exit_us long")
    carries = _carried(summary, gap, block_micros)
    return (
        firsts.join(carries, ["sig", "block"], "left")
        .repartition("sig", "block")
        .sortWithinPartitions("sig", "block", "us")
        .mapInPandas(_mark(block_micros, gap), "sig binary, rule string, ip string, us long, id long")
    )


def sliding_counts(events: DataFrame, window_seconds: int, block_micros: int) -> DataFrame:
    """Events of the same (rule, ip) in the window that ends with each event.

    Every event adds one when it happens and takes one away when it leaves the
    window; the running sum of both is the count, so no frame is ever rescanned.
    Events at one instant count in id order, the window is closed at both ends.
    """
    window = window_seconds * MICROS
    steps = events.select(
        "rule", "ip", "id",
        F.explode(F.array(
            F.struct(F.col("us").alias("us"), F.lit(0).alias("leaves"), F.lit(1).alias("step")),
            F.struct((F.col("us") + window).alias("us"), F.lit(1).alias("leaves"), F.lit(-1).alias("step")),
        )).alias("s"),
    ).select("rule", "ip", "id", "s.*")
    counted = running_totals(
        steps, ["rule", "ip"], [F.col("us"), F.col("leaves"), F.col("id")],
        {"active_event_count": F.col("step")}, F.floor(F.col("us") / F.lit(block_micros)).cast("long"))
    return counted.where("leaves = 0").select("id", "active_event_count")


def first_rule(message: Column, rules: list[CorrelationRule]) -> Column:
    """Name of the first rule of the list with a pattern in the message, else NULL."""
    return F.coalesce(*[F.when(matched_pattern(message, r).isNotNull(), r.name) for r in rules])


def correlate_rules(logs: DataFrame, rules: list[CorrelationRule], id_col: str = "event_id",
                    ts_col: str = "timestamp", message_col: str = "message") -> DataFrame:
    """As ``correlate`` for a table of rules, adding rule: an event belongs to the first rule it matches.

    Each rule has its own gap, window and threshold; the list is short and
    every rule reads its own events only.
    """
    named = logs.withColumn("rule", first_rule(F.lower(text.strip(F.coalesce(F.col(message_col), F.lit("")))), rules))
    parts = [correlate(named.where(F.col("rule") == r.name), r, id_col, ts_col, message_col) for r in rules]
    out = named.where(F.col("rule").isNull()).withColumns({
        "src_ip": source_ip(F.lower(F.coalesce(F.col(message_col), F.lit("")))), "matched_rule": F.lit(None).cast("string"),
        "active_event_count": F.lit(0).cast("long"), "correlation_triggered": F.lit(False)})
    for part in parts:
        out = out.unionByName(part)
    return out


def correlate(logs: DataFrame, rule: CorrelationRule = SSH_BRUTEFORCE, id_col: str = "event_id",
              ts_col: str = "timestamp", message_col: str = "message") -> DataFrame:
    """Add src_ip, matched_rule, active_event_count, correlation_triggered.

    Suppressed repeats are removed. Rows that match no pattern never enter a
    shuffle: only matching rows are joined to their counts. A matching row
    without a time is neither suppressed nor counted.
    """
    message = F.lower(text.strip(F.coalesce(F.col(message_col), F.lit(""))))
    tagged = logs.withColumn("src_ip", source_ip(message)).withColumn("matched_rule", matched_pattern(message, rule))
    timed = F.col("matched_rule").isNotNull() & F.col(ts_col).isNotNull()
    hits = tagged.where(timed)
    narrow = hits.select(
        F.unhex(F.md5(F.concat_ws(":", "src_ip", message))).alias("sig"),
        F.lit(rule.name).alias("rule"), F.col("src_ip").alias("ip"),
        micros(F.col(ts_col)).alias("us"), F.col(id_col).alias("id"))
    kept = accepted_events(narrow, rule.dedup_seconds, rule.block_micros)
    counts = sliding_counts(kept, rule.window_seconds, rule.block_micros).withColumnRenamed("id", id_col)
    seen = hits.join(counts, id_col, "inner")
    rest = tagged.where(~timed).withColumn("active_event_count", F.lit(0).cast("long"))
    return rest.unionByName(seen).withColumn(
        "correlation_triggered", F.col("active_event_count") >= rule.correlation_threshold)
