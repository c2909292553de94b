import re

import pytest
from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import clean, dedup, label, normalize

SAMPLES = [
    "Failed password from 10.0.0.1 port 22 pid=4242 uid=7",
    "open /var/log/a.b-c_d and C:\\temp\\x.txt at 2024-01-01T10:00:00Z by a.b@ex.com",
    "id deadbeefcafe 0x1F 0xDEADBEEF blk_-123 node-12 (123) [55] abc12345xyz 00:1A:2B:3C:4D:5E",
    "token aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 www.example.com 12:13:14 user=joe.x PID: 99",
    "٣٤٥٦ é1234 x٣ pid=٧ (٨) [٩] 1234é",
    "",
]


def by_hand(sample, rules):
    for pattern, repl in rules:
        sample = re.sub(pattern.replace(r"\p{Nd}", r"\d"), repl.replace("$1", "\\1"), sample)
    return sample


@pytest.mark.parametrize("expr, rules, tidy", [
    (text.clean_message, text.CLEAN_RULES, True),
    (text.mask_v1, text.MASK_RULES_V1, True),
    (text.mask_v2, text.MASK_RULES_V2, True),
    (text.mask_identity, text.IDENTITY_RULES, False),
])
def test_rule_chains_equal_a_plain_loop(spark, expr, rules, tidy):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, v string")
    got = {r["i"]: r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).collect()}
    for i, s in enumerate(SAMPLES):
        want = by_hand(s, rules)
        assert got[i] == (" ".join(want.split()) if tidy else want)


def test_mask_v1_on_whole_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.mask_v1(F.col("text")).alias("o")).collect()
    wrong = [r for r in rows if " ".join(by_hand(r["text"], text.MASK_RULES_V1).split()) != r["o"]]
    assert not wrong


def test_null_becomes_empty(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(text.clean_message(F.col("v"))).first()[0] == ""


def test_node_ids_keep_the_order_of_the_rules(spark):
    df = spark.createDataFrame([("node-12",)], "v string")
    assert df.select(text.mask_identity(F.col("v"))).first()[0] == "node-NUM"


def test_vector_rows_are_set_aside(spark):
    df = spark.createDataFrame([("1,2,3,4,5,6",), ("a,b,c,d",), ("",), (None,), ("12345678",)], "message string")
    kept, bad = clean.split_vector_like(df)
    assert [r[0] for r in bad.collect()] == ["1,2,3,4,5,6"]
    assert kept.count() == 4


def test_upload_repairs(spark):
    df = spark.createDataFrame([("75", "m"), ("0.5", "m"), ("-3", "m"), ("x", "m"), ("", "m"), ("nan", "m")], "Score string, Msg string")
    out = normalize.normalize_upload(df, "upload", F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert [r["prob_anomaly"] for r in out] == [0.75, 0.5, 0.0, 0.0, 0.0, 0.0]
    assert [r["is_anomaly_pred"] for r in out] == [1, 0, 0, 0, 0, 0]
    assert all(r["pid"] == -1 and r["host"] == "" for r in out)


def test_a_synonym_does_not_replace_an_existing_column(spark):
    df = spark.createDataFrame([("a", "b")], "message string, msg string")
    assert normalize.rename_headers(df).columns == ["message", "msg"]


def test_last_label_wins_and_invalid_last_label_removes(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 7), (5, "c", 1), (6, "c", 0), (7, "c", 1)],
                               "seq int, message string, true_label int")
    got = {r["message"]: r["true_label"] for r in dedup.resolve_feedback(df, "seq").collect()}
    # The repeat of (c, 1) counts where it first stood, so 0 is the last label.
    assert got == {"a": 1, "c": 0}
    report = dedup.feedback_report(df, "seq").first()
    assert (report["initial_rows"], report["distinct_rows"], report["conflicts_resolved"], report["final_rows"]) == (7, 6, 3, 2)


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "h", "s", 0, "m"), (2, "h", "s", 0, " m "), (3, "h", "s", 5, "m")],
                               "id int, host string, service string, pid int, message string")
    once = dedup.first_records(df, ["id"])
    assert sorted(r["id"] for r in once.collect()) == [1, 3]
    assert dedup.first_records(once.drop("row_key"), ["id"]).count() == 2


def test_block_labels(spark):
    logs = spark.createDataFrame([(1, "x blk_-5 y"), (2, "blk_7"), (3, "none")], "i int, message string")
    dim = spark.createDataFrame([("blk_-5", 0, 1), ("blk_-5", 1, 2)], "block_id string, true_label int, seq int")
    got = {r["i"]: r["true_label"] for r in label.lookup_block_labels(logs, dim, "seq").collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_agreement_is_unknown_without_a_suggestion(spark):
    df = spark.createDataFrame([("closed", 0.9), ("false_positive", 0.9), ("closed", 0.5)], "action string, prob_anomaly double")
    assert [r["agreement"] for r in label.feedback_log(df).collect()] == [True, False, None]


def test_guards_leave_out_no_match(spark):
    """Guarded rules give what the rules give one after another without guards."""
    import random
    rng = random.Random(12)
    bits = ["pid=", "pids", "PID:", "pıd=", "uid=", "user=", "a.b", "10.0.0.1", "١٢٣٤", "2024-01-02T03:04:05", "12:34:56", "/var/x", "C:\\x", "[12]", "(7)",
            "a@b.co", "host.example.org", "0xdeadbeef", "deadbeef", "blk_-12", "node-7", "aa:bb:cc:dd:ee:ff", " ", "  ", "\n", "x" * 9, "é", "9", ".", "-", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    rules = [text.CLEAN_RULES, text.MASK_RULES_V1[:2] + text.MASK_RULES_V1[3:], text.MASK_RULES_V2, text.IDENTITY_RULES]
    for r in rules:
        plain = F.col("t")
        for pattern, new in r:
            flat = text.FLAT_FORMS.get(pattern)
            plain = F.regexp_replace(plain, "(?U)" + (flat or pattern), "$1" + new if flat else new)
        bad = df.select("t", text.apply_rules(F.col("t"), r).alias("a"), plain.alias("b")).where("a <> b").collect()
        assert not bad, bad[:3]
    spaces = F.trim(F.regexp_replace("t", f"{text.WS}+", " "))
    odd = spark.createDataFrame([("".join(rng.choice(["a", " ", "\t", "\u00a0", "\u2003", "\u001c", "\u0085", "\u3000", "b"]) for _ in range(12)),)
                                 for _ in range(500)], "t string")
    assert odd.select(text.collapse(F.col("t")).alias("a"), spaces.alias("b")).where("a <> b").count() == 0
