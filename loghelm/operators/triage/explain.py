"""Rule tables compiled to expressions: no shuffle, no join, one pass.

Which rules share a category is known when the plan is built, so "one per
category, highest priority, first on ties" is a COALESCE over the category's
rules. A fired rule is held as one integer that sorts by priority, then by
place in the table; texts are looked up for the few entries that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.text import contains_any
from loghelm.operators.triage import rules
from loghelm.operators.triage.context import with_context, without_context

_PLACES = 1000


def _code(number: int, priority: int) -> int:
    return (100 - priority) * _PLACES + number


def _topics(category: str) -> int:
    """Bit set of the topics a category belongs to."""
    return sum(1 << i for i, words in enumerate(rules.TOPICS.values()) if any(w in category for w in words))


def _entries(table: list[tuple], fallback: list[tuple]) -> list[tuple[str, int, str]]:
    return [(c, p, t) for c, p, _, t in table] + list(fallback)


def add_fired(df: DataFrame, name: str, table: list[tuple], fallback: list[tuple]) -> DataFrame:
    """Add the sorted codes of the winning rules; those of the fallback when none fired."""
    by_category: dict[str, list[tuple[int, int, str]]] = {}
    for number, (category, priority, cond, _) in enumerate(table, start=1):
        by_category.setdefault(category, []).append((_code(number, priority), number, cond))
    winners = []
    for entries in by_category.values():
        whens = [F.when(F.expr(cond), F.lit(code)) for code, _, cond in sorted(entries)]
        winners.append(F.coalesce(*whens) if len(whens) > 1 else whens[0])
    spare = sorted(_code(len(table) + i, priority) for i, (_, priority, _) in enumerate(fallback, start=1))
    hits = df.withColumn(name, F.sort_array(F.array_compact(F.array(*winners))))
    return hits.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(*[F.lit(s) for s in spare])))


def _expanded(codes: Column, entries: list[tuple[str, int, str]], place: str, extra=None) -> Column:
    """Codes to structs of place, rule, category, priority and text."""
    known = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(p).alias("priority"), F.lit(t).alias("text")) for c, p, t in entries])

    def entry(code: Column, i: Column) -> Column:
        rule = (code % _PLACES).cast("int")
        e = F.element_at(known, rule)
        filled = F.replace(F.replace(e["text"], F.lit("{n}"), F.col("x_n").cast("string")), F.lit("{reason}"), F.col("x_reason"))
        return F.struct(
            i.alias(place), rule.alias("rule"), e["category"].alias("category"), e["priority"].alias("priority"),
            filled.alias("text"), *(extra(e) if extra else []))

    return F.transform(codes, entry)


def detection_factors(df: DataFrame) -> DataFrame:
    """Add ``factors``: every category that fired, best first."""
    coded = add_fired(with_context(df), "factors", rules.FACTORS, rules.FACTOR_FALLBACK)
    entries = _entries(rules.FACTORS, rules.FACTOR_FALLBACK)
    return without_context(coded.withColumn("factors", _expanded(F.col("factors"), entries, "position")))


def _selected(codes: Column, entries: list[tuple[str, int, str]]) -> Column:
    """Critical categories first, then others on topics not yet covered, six at most."""
    topics = F.array(*[F.lit(_topics(c)) for c, _, _ in entries])
    critical = F.array(*[F.lit(c in rules.CRITICAL_CATEGORIES) for c, _, _ in entries])

    def place(code: Column) -> Column:
        return (code % _PLACES).cast("int")

    always = F.filter(codes, lambda c: F.element_at(critical, place(c)))
    others = F.filter(codes, lambda c: ~F.element_at(critical, place(c)))
    seen = F.aggregate(always, F.lit(0), lambda acc, c: acc.bitwiseOR(F.element_at(topics, place(c))))

    def step(acc: Column, c: Column) -> Column:
        topic = F.element_at(topics, place(c))
        skip = (F.size(acc["chosen"]) >= rules.SHOWN_FACTORS) | (acc["seen"].bitwiseAND(topic) != 0)
        return F.when(skip, acc).otherwise(F.struct(
            F.concat(acc["chosen"], F.array(c)).alias("chosen"), acc["seen"].bitwiseOR(topic).alias("seen")))

    start = F.struct(always.alias("chosen"), seen.alias("seen"))
    return F.slice(F.aggregate(others, start, step, lambda acc: acc["chosen"]), 1, rules.SHOWN_FACTORS)


def factor_class(priority: Column) -> Column:
    out = F.lit("plain")
    for cut, name in reversed(rules.CLASS_CUTS):
        out = F.when(priority >= cut, name).otherwise(out)
    return out


def _marks(e: Column) -> list[Column]:
    return [
        factor_class(e["priority"]).alias("factor_class"),
        e["category"].contains("mitre").alias("mitre"),
        (e["category"].contains("behavioral") | e["category"].contains("correlation")).alias("correlation"),
    ]


def shown_factors(df: DataFrame) -> DataFrame:
    """Add ``factors``: the selection an analyst sees, with class and marks of each entry."""
    coded = add_fired(with_context(df), "factors", rules.FACTORS, rules.FACTOR_FALLBACK)
    entries = _entries(rules.FACTORS, rules.FACTOR_FALLBACK)
    picked = coded.withColumn("factors", _selected(F.col("factors"), entries))
    return without_context(picked.withColumn("factors", _expanded(F.col("factors"), entries, "position", _marks)))


def attack_mapping(df: DataFrame, message: str = "message") -> DataFrame:
    """Add ``attack``: array of (tactic, technique, technique_id), empty when none applies."""
    folded = F.lower(F.coalesce(F.col(message), F.lit("")))
    entries = [
        F.when(contains_any(folded, words), F.struct(
            F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"), F.lit(number).alias("technique_id")))
        for words, tactic, technique, number in rules.ATTACK]
    return df.withColumn("attack", F.array_compact(F.array(*entries)))


def recommendations(df: DataFrame) -> DataFrame:
    """Add ``recommendations``: the five best, one per category."""
    coded = add_fired(with_context(df), "recommendations", rules.RECOMMENDATIONS, rules.RECOMMENDATION_FALLBACK)
    best = F.slice("recommendations", 1, rules.SHOWN_RECOMMENDATIONS)
    entries = _entries(rules.RECOMMENDATIONS, rules.RECOMMENDATION_FALLBACK)
    return without_context(coded.withColumn("recommendations", _expanded(best, entries, "place")))


def decisions(df: DataFrame) -> DataFrame:
    """Add ``decision`` and ``decision_reason`` to every row."""
    decision = reason = F.lit(None).cast("string")
    for cond, name, why in reversed(rules.DECISIONS):
        decision = F.when(F.expr(cond), name).otherwise(decision)
        reason = F.when(F.expr(cond), why).otherwise(reason)
    status = F.when(F.col("x_status") == "", "NEW").otherwise(F.col("x_status"))
    out = with_context(df).withColumn("x_status", status)
    return without_context(out.withColumns({"decision": decision, "decision_reason": reason}))


def top_decision(df: DataFrame, tie: str) -> DataFrame:
    """Decision on the top row by threat score and time; a fixed answer for no rows."""
    order = F.struct(F.coalesce("threat_score", F.lit(0)), "timestamp", tie)
    best = decisions(df).agg(F.max_by(F.struct("decision", "decision_reason"), order).alias("d"))
    return best.select(
        F.coalesce("d.decision", F.lit(rules.NO_DECISION[0])).alias("decision"),
        F.coalesce("d.decision_reason", F.lit(rules.NO_DECISION[1])).alias("decision_reason"))


def investigation(df: DataFrame) -> DataFrame:
    """One record per anomaly: shown factors, ATT&CK mapping, recommendations, decision."""
    return decisions(recommendations(attack_mapping(shown_factors(df))))


def as_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per entry of an array column.

    The outer form: a plain generator makes the optimizer test the array's size
    below the scan, which evaluates every rule a second time.
    """
    return df.select(*keep, F.inline_outer(column))
