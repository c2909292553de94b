"""Explanation and triage queries."""

from pyspark.sql import functions as F

from loghelm.operators import query as ops
from loghelm.operators.triage import explain, rules
from loghelm.operators.triage.context import FLAG_WORDS, with_context
from loghelm.plans import sqltext as q
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

_FLAGS = ", ".join(f"{q.any_of('lower(message)', words)} AS x_{name}" for name, words in FLAG_WORDS.items())
_LAST = """, lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY action_time DESC, status DESC) AS rn
  FROM v_actions WHERE status IN ('acknowledged', 'closed', 'false_positive')) WHERE rn = 1)
"""
_CTX = with_views("v_anoms", "v_actions").rstrip() + _LAST + f""", ctx AS (SELECT event_id, timestamp AS x_time, lower(message) AS x_msg, lower(service) AS x_service, upper(severity) AS x_sev,
 upper(coalesce(status, 'new')) AS x_status, prob_anomaly AS x_prob, correlation_triggered AS x_corr, active_event_count AS x_n, escalation_reason AS x_reason,
 threat_score AS x_threat, {_FLAGS}, severity = 'CRITICAL' AS x_crit, severity IN ('HIGH', 'CRITICAL') AS x_hs
 FROM v_anoms LEFT JOIN lasts ON anomaly_id = event_id)
"""


def _text_sql(template: str) -> str:
    if "{n}" in template:
        a, b = template.split("{n}")
        return f"{q.quoted(a)} || CAST(x_n AS VARCHAR) || {q.quoted(b)}"
    if "{reason}" in template:
        return f"{q.quoted(template.split('{reason}')[0])} || x_reason"
    return q.quoted(template)


def _fired_sql(table_, fallback) -> str:
    """All firing rules, then the best per category by window."""
    selects = [
        f"SELECT event_id, {i} AS rule, {q.quoted(c)} AS category, {p} AS priority, {_text_sql(t)} AS text FROM ctx WHERE {cond}"
        for i, (c, p, cond, t) in enumerate(table_, start=1)]
    spare = [
        f"SELECT event_id, {len(table_) + i} AS rule, {q.quoted(c)} AS category, {p} AS priority, {q.quoted(t)} AS text FROM ctx WHERE event_id NOT IN (SELECT event_id FROM raised)"
        for i, (c, p, t) in enumerate(fallback, start=1)]
    return _CTX + ", raised AS (" + " UNION ALL ".join(selects) + "), all_ AS (SELECT * FROM raised UNION ALL " + " UNION ALL ".join(spare) + """),
best AS (SELECT event_id, rule, category, priority, text FROM (SELECT *, row_number() OVER (PARTITION BY event_id, category ORDER BY priority DESC, rule) AS rn FROM all_) WHERE rn = 1)
"""


def cases(spark, sf):
    return ops.case_status(table(spark, sf, "v_anoms"), table(spark, sf, "v_actions"), "event_id")


@query("threat_context", _CTX + "SELECT event_id, " + ", ".join(f"x_{n}" for n in FLAG_WORDS) + ", x_corr, x_crit, x_hs FROM ctx")
def threat_context(spark, sf):
    return with_context(table(spark, sf, "v_anoms")).select("event_id", *[f"x_{n}" for n in FLAG_WORDS], "x_corr", "x_crit", "x_hs")


@query("detection_factors", _fired_sql(rules.FACTORS, rules.FACTOR_FALLBACK) + "SELECT event_id, rule, category, priority, text FROM best")
def detection_factors(spark, sf):
    out = explain.as_rows(explain.detection_factors(table(spark, sf, "v_anoms")), "factors", "event_id")
    return out.drop("position")


# The greedy selection has no SQL twin; tests compare it with a plain loop.
@query("shown_factors")
def shown_factors(spark, sf):
    return explain.as_rows(explain.shown_factors(table(spark, sf, "v_anoms")), "factors", "event_id")


@query("factor_classes", _fired_sql(rules.FACTORS, rules.FACTOR_FALLBACK) + """SELECT category, priority, CASE WHEN priority >= 100 THEN 'critical' WHEN priority >= 95 THEN 'high'
 WHEN priority >= 85 THEN 'medium' ELSE 'plain' END AS factor_class, count(*) AS anomalies FROM best GROUP BY 1, 2, 3""")
def factor_classes(spark, sf):
    out = explain.as_rows(explain.detection_factors(table(spark, sf, "v_anoms")), "factors")
    return out.groupBy("category", "priority", explain.factor_class(F.col("priority")).alias("factor_class")).agg(
        F.count(F.lit(1)).alias("anomalies"))


@query("attack_mapping", _CTX + " UNION ALL ".join(
    f"SELECT event_id, {q.quoted(ta)} AS tactic, {q.quoted(te)} AS technique, {q.quoted(no)} AS technique_id FROM ctx WHERE {q.any_of('x_msg', w)}"
    for w, ta, te, no in rules.ATTACK) + " UNION ALL SELECT event_id, NULL, NULL, NULL FROM ctx WHERE NOT (" + " OR ".join(
    q.any_of("x_msg", w) for w, *_ in rules.ATTACK) + ")")
def attack_mapping(spark, sf):
    return explain.as_rows(explain.attack_mapping(table(spark, sf, "v_anoms")), "attack", "event_id")


@query("recommendations", _fired_sql(rules.RECOMMENDATIONS, rules.RECOMMENDATION_FALLBACK) + """
SELECT event_id, place, category, priority, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, rule) - 1 AS INT) AS place FROM best) WHERE place < 5""")
def recommendations(spark, sf):
    return explain.as_rows(explain.recommendations(cases(spark, sf)), "recommendations", "event_id").drop("rule")


_DECIDED = "CASE " + " ".join(f"WHEN {c} THEN {q.quoted(n)}" for c, n, _ in rules.DECISIONS) + " END"


@query("decisions", _CTX + f"SELECT event_id, {_DECIDED} AS decision FROM ctx")
def decisions(spark, sf):
    return explain.decisions(cases(spark, sf)).select("event_id", "decision")


@query("top_decision", _CTX + f"""SELECT {_DECIDED} AS decision, CASE {' '.join(f"WHEN {c} THEN {q.quoted(w)}" for c, _, w in rules.DECISIONS)} END AS decision_reason
FROM ctx ORDER BY x_threat DESC, x_time DESC, event_id DESC LIMIT 1""")
def top_decision(spark, sf):
    return explain.top_decision(cases(spark, sf), "event_id")


@query("investigation_records")
def investigation_records(spark, sf):
    full = explain.investigation(cases(spark, sf))
    return full.select("event_id", "status", "decision", F.to_json("factors").alias("factors"), F.to_json("attack").alias("attack"),
                       F.to_json("recommendations").alias("recommendations"))
