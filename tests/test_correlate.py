import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loghelm.operators import correlate as co
from loghelm.operators import detect

S = co.MICROS


def accepted(spark, times, gap, block, sig="a"):
    rows = [(bytearray(s.encode()), "r", "ip", t, i) for i, (s, t) in enumerate(times)]
    df = spark.createDataFrame(rows, "sig binary, rule string, ip string, us long, id long")
    out = co.accepted_events(df, gap, block)
    return sorted((bytes(r["sig"]).decode(), r["us"]) for r in out.collect())


def plain(times, gap):
    out, last = [], {}
    for s, t in sorted(set(times)):
        if s not in last or t - last[s] > gap * S:
            last[s] = t
            out.append((s, t))
    return sorted(out)


def test_chain_compares_with_the_last_accepted_event(spark):
    at = [("a", int(x * S)) for x in (0, 10, 20, 30)]
    assert [t // S for _, t in accepted(spark, at, 15, 3600 * S)] == [0, 20]
    at = [("a", int(x * S)) for x in (0, 15, 30.001)]
    assert [t / S for _, t in accepted(spark, at, 15, 3600 * S)] == [0, 30.001]


@pytest.mark.parametrize("seed, spread, gap, block", [(1, 400, 15, 20), (2, 4000, 15, 40), (3, 200, 7, 8), (4, 100000, 15, 64), (5, 300, 15, 16)])
def test_blocks_hand_over_the_chain(spark, seed, spread, gap, block):
    rng = random.Random(seed)
    times = [(rng.choice("abc"), rng.randrange(0, spread) * S // 2) for _ in range(600)]
    assert accepted(spark, times, gap, block * S) == plain(times, gap)


@pytest.mark.parametrize("fan_out", [2, 3, 16])
@pytest.mark.parametrize("gap, block", [(15, 20), (7, 8), (15, 64)])
def test_ranges_of_ranges_hand_over_the_chain(spark, monkeypatch, fan_out, gap, block):
    """Beats that never merge, gaps of whole ranges, and times on both sides of 1970, over many levels."""
    monkeypatch.setattr(co, "FAN_OUT", fan_out)
    monkeypatch.setattr(co, "MIN_MICROS", -4000 * S)
    monkeypatch.setattr(co, "MAX_MICROS", 9000 * S)
    rng = random.Random(fan_out * block)
    times = [("a", i * 10 * S) for i in range(-300, 700)] + [("b", i * S // 2) for i in range(-200, 900)]
    times += [("c", rng.randrange(-3900, 8900) * S) for _ in range(500)] + [("d", i * gap * S + rng.randrange(2)) for i in range(300)]
    assert accepted(spark, times, gap, block * S) == plain(times, gap)


def test_no_step_of_the_carry_is_keyed_by_signature_alone(spark):
    import io
    from contextlib import redirect_stdout
    df = spark.createDataFrame([(bytearray(b"a"), "r", "ip", 0, 1)], "sig binary, rule string, ip string, us long, id long")
    shown = io.StringIO()
    with redirect_stdout(shown):
        co.accepted_events(df, 15, 480 * S).explain("formatted")
    keys = [line for line in shown.getvalue().splitlines() if "hashpartitioning(" in line]
    assert keys and not any("hashpartitioning(sig#" in k and k.split("hashpartitioning(")[1].count("#") == 1 for k in keys)


def test_regular_beats_that_never_merge(spark):
    times = [("a", i * 10 * S) for i in range(500)] + [("b", i * S // 3) for i in range(900)]
    assert accepted(spark, times, 15, 47 * S) == plain(times, 15)


def test_window_is_closed_at_both_ends(spark):
    df = spark.createDataFrame([("r", "ip", 0, 1), ("r", "ip", 60 * S, 2), ("r", "ip", 61 * S, 3), ("r", "ip", 61 * S, 4)],
                               "rule string, ip string, us long, id long")
    got = {r["id"]: r["active_event_count"] for r in co.sliding_counts(df, 60, 30 * S).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3}


def test_sliding_counts_equal_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [("r", rng.choice(["x", "y"]), rng.randrange(0, 2000) * S // 4, i) for i in range(700)]
    df = spark.createDataFrame(rows, "rule string, ip string, us long, id long")
    got = {r["id"]: r["active_event_count"] for r in co.sliding_counts(df, 60, 100 * S).collect()}
    for _, ip, us, i in rows:
        want = sum(1 for _, p, u, j in rows if p == ip and us - 60 * S <= u and (u, j) <= (us, i))
        assert got[i] == want


def logs(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, service string, message string, prob_anomaly double")
    return df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).withColumn("host", F.lit("h")).withColumn("pid", F.lit(1))


def test_escalation(spark):
    def at(i, second, ip="10.0.0.9", prob=0.1):
        return (i, f"2024-01-01 00:00:{second:02d}", "SSHD", f"Failed password attempt {i} from {ip}", prob)

    rows = [at(i, i * 2) for i in range(1, 7)] + [at(20, 1, "10.0.0.8"), (30, "2024-01-01 00:00:00", "CRON", "job", 0.79),
                                                  (31, "2024-01-01 00:00:00", "CRON", "job two", 0.81), (32, "2024-01-01 00:00:00", "x", " nan ", 0.99)]
    out = {r["event_id"]: r for r in detect.detect(logs(spark, rows)).collect()}
    assert set(out) == {3, 4, 5, 6, 31}
    assert out[3]["severity"] == "HIGH" and out[3]["threat_score"] == 75 and out[3]["active_event_count"] == 3
    assert out[5]["severity"] == "CRITICAL" and out[5]["threat_score"] == 100
    assert out[6]["escalation_reason"] == co.ESCALATED and out[31]["escalation_reason"] == co.NOT_ESCALATED
    strict = {r["event_id"] for r in detect.detect(logs(spark, rows), strict_reference=True).collect()}
    assert strict == {3, 4, 5, 6, 30, 31}


def test_suppressed_repeats_never_become_anomalies(spark):
    rows = [(1, "2024-01-01 00:00:00", "sshd", "ssh login from 10.0.0.1", 0.99), (2, "2024-01-01 00:00:10", "sshd", "ssh login from 10.0.0.1", 0.99)]
    assert [r["event_id"] for r in detect.detect(logs(spark, rows)).collect()] == [1]


def test_block_must_exceed_the_gap(spark):
    rule = replace(co.SSH_BRUTEFORCE, dedup_seconds=100, block_seconds=50)
    with pytest.raises(ValueError):
        co.correlate(logs(spark, [(1, "2024-01-01 00:00:00", "sshd", "ssh", 0.9)]), rule)


def test_rule_table_returns_every_rule_and_the_rest(spark, sf):
    from loghelm.plans.registry import QUERIES
    from loghelm.plans.detect_plans import _SCAN_RULE, WIDE_RULE
    from loghelm.plans.views import table
    found = QUERIES["correlate_rule_table_all"](spark, sf).collect()
    rules = {r["event_id"]: r["rule"] for r in QUERIES["rule_table_matches"](spark, sf).collect()}
    assert {r["rule"] for r in found} == {"ssh_bruteforce", "port_scan", None}
    assert all(r["rule"] == rules[r["event_id"]] for r in found)
    assert {r["event_id"] for r in found if r["rule"] is None} == {i for i, rule in rules.items() if rule is None}
    # each rule's events come out as they do alone
    for name, rule in (("ssh_bruteforce", WIDE_RULE), ("port_scan", _SCAN_RULE)):
        own = table(spark, sf, "v_logs").where(F.col("event_id").isin([i for i, r in rules.items() if r == name]))
        alone = {(r["event_id"], r["active_event_count"], r["correlation_triggered"]) for r in co.correlate(own, rule).collect()}
        assert {(r["event_id"], r["active_event_count"], r["correlation_triggered"]) for r in found if r["rule"] == name} == alone
