from loghelm.operators.triage import explain, rules
from loghelm.plans.views import table


def test_rule_counts():
    assert len(rules.FACTORS) + len(rules.FACTOR_FALLBACK) == 70
    assert len(rules.RECOMMENDATIONS) + len(rules.RECOMMENDATION_FALLBACK) == 47
    assert len(rules.ATTACK) == 4


def topics_of(category):
    return {name for name, words in rules.TOPICS.items() if any(w in category for w in words)}


def by_hand(factors):
    """Selection as a plain loop over sorted factors."""
    chosen = [f for f in factors if f in rules.CRITICAL_CATEGORIES]
    for f in factors:
        if len(chosen) >= rules.SHOWN_FACTORS:
            break
        if f in chosen or any(topics_of(f) & topics_of(c) for c in chosen):
            continue
        chosen.append(f)
    return chosen[:rules.SHOWN_FACTORS]


def test_selection_equals_a_plain_loop(spark, sf):
    anomalies = table(spark, sf, "v_anoms")
    every = {r["event_id"]: [f["category"] for f in r["factors"]] for r in explain.detection_factors(anomalies).collect()}
    shown = {r["event_id"]: [f["category"] for f in r["factors"]] for r in explain.shown_factors(anomalies).collect()}
    assert len(every) > 500
    assert {k: by_hand(v) for k, v in every.items()} == shown


def row(spark, **over):
    base = {"message": "quiet", "service": "app", "severity": "OTHER", "prob_anomaly": 0.1, "correlation_triggered": False,
            "active_event_count": 0, "escalation_reason": "", "threat_score": 0, "status": "NEW"}
    return spark.createDataFrame([{**base, **over}])


def test_fallbacks(spark):
    assert [f["category"] for f in explain.detection_factors(row(spark)).first()["factors"]] == ["baseline_deviation"]
    assert [r["category"] for r in explain.recommendations(row(spark)).first()["recommendations"]] == ["general_correlation", "monitoring"]
    assert explain.attack_mapping(row(spark)).first()["attack"] == []


def test_texts_are_filled(spark):
    r = row(spark, correlation_triggered=True, active_event_count=5, escalation_reason="why", severity="CRITICAL")
    texts = {f["category"]: f["text"] for f in explain.detection_factors(r).first()["factors"]}
    assert texts["multi_event_activity"] == "Multiple correlated suspicious events detected (5 related events observed)"
    assert texts["escalation_reasoning"] == "Escalation rationale: why"


def test_first_recommendation_of_a_category_wins(spark):
    r = row(spark, status="CLOSED", service="hdfs-node")
    got = explain.recommendations(r).first()["recommendations"]
    assert [(x["category"], x["text"]) for x in got] == [("general", "Incident already resolved by analyst workflow")]


def test_decisions(spark):
    cases = [({"status": "acknowledged"}, "ESCALATE OR CLOSE"), ({"severity": "HIGH", "prob_anomaly": 0.8}, "ACKNOWLEDGE & INVESTIGATE"),
             ({"severity": "HIGH", "prob_anomaly": 0.7}, "REVIEW"), ({"severity": "MEDIUM"}, "REVIEW"), ({}, "FALSE POSITIVE REVIEW")]
    for over, want in cases:
        assert explain.decisions(row(spark, **over)).first()["decision"] == want


def test_top_decision_without_rows(spark, sf):
    empty = table(spark, sf, "v_anoms").where("1 = 0")
    assert explain.top_decision(empty, "event_id").first()["decision"] == "NO ACTIVE ANOMALIES"
