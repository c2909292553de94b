"""Cases that once went wrong: long runs, other scripts' digits, offsets, missing times and scores, odd CSV."""

import datetime as dt
import re
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghelm.functions import text
from loghelm.operators import correlate, dedup, evaluate, query
from loghelm.operators.ml.retrain import training_rows
from loghelm.sources import readers, writers


def run(spark, fn, *values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(fn(F.col("v"))).collect()]


def test_long_paths_and_hosts(spark):
    path, host = "/ab" * 100_000, "a." * 100_000 + "com"
    assert run(spark, text.clean_message, "see " + path) == ["see <PATH>"]
    assert run(spark, text.mask_v1, "see " + path) == ["see <PATH>"]
    assert run(spark, text.mask_v2, "see " + host) == ["see <HOST>"]
    assert run(spark, text.mask_v2, "see " + "a." * 100_000 + " x") == ["see " + "a." * 100_000 + " x"]


def test_long_line_of_plain_words(spark):
    line = "abcdefgh " * 110_000
    began = time.time()
    assert run(spark, text.mask_v1, line + "1x") == [("<ID> " * 110_000 + "1x")]
    assert run(spark, text.mask_v1, line) == [line.strip()]
    assert time.time() - began < 30


def test_flat_forms_match_the_same(spark):
    values = ["/a//b/", "a/b.c/-x", "foo.com.123 a..com x.co.", "-a.bc é.com a.b@c.de a@b", "/", "x.y.z1 www.Ab.CD/e", "a.b.c.de.1f",
              "..foo.com", "a@b.com-c@d.com", "-c@d.com %%x@y.zz", "a.b..c.de-f.gh", "x@y@z.com", "a.b.c.d.e.f"]
    for spec, flat in text.FLAT_FORMS.items():
        got = run(spark, lambda c: F.regexp_replace(c, flat, "$1#"), *values)
        assert got == [re.sub(spec, "#", v, flags=re.A) for v in values]


def test_mixed_tokens_like_look_ahead(spark):
    spec = text.MASK_RULES_V1[2][0].replace(r"\p{Nd}", r"\d")
    values = ["abcdefgh ijklmnop 1", "abcdefgh\n1 ijklmnopq", "12345678 x", "12345678 .", "a_bcdefghi1 abcdefgh_ x9 zzzzzzzz", "abcdefg1_ x1",
              "", "abcdefgh é1", "éabcdefgh1 9", "aaaaaaaa1bbbb cccccccc", "x1abcdefg\rabcdefghi"]
    got = run(spark, lambda c: text.mask_mixed_tokens(c, "#"), *values)
    # the reference's dot stops at line feeds only
    want = ["\r".join(re.sub(spec, "#", p) for p in v.split("\r")) for v in values]
    assert got == want


def test_digits_of_any_script(spark):
    assert run(spark, text.clean_message, "id ٣٤٥٦ x", "é1234 1234") == ["id <NUM> x", "é1234 <NUM>"]
    assert run(spark, text.mask_identity, "n ٣٤") == ["n NUM"]


def test_times_with_offsets(spark):
    values = ["2024-01-01T10:00:00+05:30", "2024-01-01 10:00:00Z", "2024-01-01 10:00:00", "2024-01-01", "bad", ""]
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    assert run(spark, text.utc, *values) == [at(4, 30), at(10), at(10), at(0), None, None]
    rows = spark.createDataFrame([(at(4, 30),), (at(5),)], "detected_at timestamp_ntz")
    assert query.filter_anomalies(rows, start="2024-01-01T10:15:00+05:30").count() == 1


def test_times_with_hours_and_zone_names(spark):
    values = ["2024-01-01T10:00:00+05", "2024-01-01 10:00:00.5 -03", "2024-01-01T10:00:00 Asia/Kolkata", "2024-01-01 10:00 UTC", "2024-01-01T10:00:00+0530",
              "2024-01-01T10:00:00 Nowhere/Land", "2024-07-01T10:00:00 Europe/Paris", "2024-01-01T10:00:00"]
    at = lambda h, m=0, us=0, month=1: dt.datetime(2024, month, 1, h, m, 0, us)
    assert run(spark, text.utc, *values) == [at(5), at(13, 0, 500000), at(4, 30), at(10), at(4, 30), None, at(8, 0, 0, 7), at(10)]


def test_typed_csv_keeps_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"say ""hi"", 3"\n3,plain\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert [tuple(r) for r in readers.csv_typed(spark, str(path), schema).collect()] == [(1, "x\ny"), (2, 'say "hi", 3'), (3, "plain")]


def test_missing_times_suppress_nothing(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=s), "failed password for root from 10.0.0.1") for i, s in enumerate((0, 10, 20))]
    rows += [(3, None, rows[0][2]), (4, None, "failed password for root from 10.0.0.2")]
    found = correlate.correlate(spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, message string")).collect()
    assert sorted((r["event_id"], r["active_event_count"]) for r in found) == [(0, 1), (2, 2), (3, 0), (4, 0)]


def test_missing_scores_move_no_curve(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.5), ("m", 1, 0.4), ("m", 0, 0.1)]
    frame = spark.createDataFrame(rows, "model string, label int, score double")
    more = frame.union(spark.createDataFrame([("m", 1, None), ("m", 0, None)], frame.schema))
    for curve in (evaluate.roc_curve, evaluate.pr_curve, evaluate.curve_areas):
        assert sorted(map(str, curve(frame, ["model"]).collect())) == sorted(map(str, curve(more, ["model"]).collect()))


def test_feedback_equal_but_for_space_stays(spark):
    original = spark.createDataFrame([(1, "o", 0)], "id long, message string, true_label int")
    feedback = spark.createDataFrame([(1, "x", 0), (2, " x", 1), (3, "x ", 1)], "seq long, message string, true_label int")
    rows, _ = training_rows(original, feedback, "seq")
    found = rows.collect()
    assert sorted((r["message"], r["label"]) for r in found) == [("o", 0), ("x", 0), ("x", 1), ("x", 1)]
    assert len({r["id"] for r in found}) == 4


def test_csv_as_users_write_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,x,y\n2,z\n3,"two\nlines",w\n4,p,q,r\n5,p,q,\na,b,c\n\n6,"say ""hi""",\n7\n')
    found = sorted(tuple(r) for r in readers.csv_strings(spark, str(tmp_path / "a.csv")).collect())
    assert found == [("1", "x", "y"), ("2", "z", ""), ("3", "two\nlines", "w"), ("6", 'say "hi"', ""), ("7", "", ""), ("a", "b", "c")]
    frame = spark.createDataFrame([("1", "x\ny", ""), ("2", 'q"', ",")], "a string, b string, c string")
    writers.export_csv(frame, str(tmp_path / "out"))
    back = readers.csv_strings(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))
    assert [r["b"] for r in back.select("b").collect()].count("x\ny") == 1


def test_first_record_per_key(spark):
    rows = [(i, "h", None if i % 2 else "s", i % 3, "m") for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, host string, service string, pid int, message string")
    found = dedup.first_records(frame, ["event_id"]).collect()
    want = {}
    for i, h, s, p, m in rows:
        want.setdefault((h, s or "", p or "", m), i)
    assert sorted(r["event_id"] for r in found) == sorted(want.values())
    plan = dedup.first_records(frame, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_registered_models_run_at_full_settings(spark):
    # settings of the specification: 200 trees without a depth limit, five folds, 3,000 terms,
    # a grid over trees, depth, split and leaf size, ten random draws
    from inspect import signature

    from loghelm.operators.ml import forest, isolation, linear, models
    from loghelm.plans import model_plans as plans
    own = {n: p.default for n, p in signature(forest.fit_forest).parameters.items()}
    own |= plans.SETS["random_forest"]
    assert (own["numTrees"], own["maxDepth"], own["minInstancesPerSplit"], own["featureSubsetStrategy"]) == (200, None, 2, "sqrt")
    assert models.logistic(1.0, **plans.SETS["logreg"]).getMaxIter() == 500
    assert signature(linear.fit_squared_hinge).parameters["rounds"].default >= 100 and plans.SETS["linear_svm"] == {}
    assert (plans.FOLDS, plans.TERMS, models.RANDOM_DRAWS, isolation.TREES, isolation.SAMPLE) == (5, 3000, 10, 200, 256)
    assert models.GRID == {"numTrees": [100, 200], "maxDepth": [None, 20, 40], "minInstancesPerSplit": [2, 5], "minInstancesPerNode": [1, 2]}


def test_rule_table(spark):
    base = dt.datetime(2024, 1, 1)
    ssh, scan = correlate.SSH_BRUTEFORCE, correlate.CorrelationRule("scan", ("scan",), 60, 5, 2)
    rows = [(i, base + dt.timedelta(seconds=20 * i), m) for i, m in enumerate(
        ["ssh failed", "a scan 1", "a scan 1", "ssh scan", "quiet", "a scan 2"])]
    frame = spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, message string")
    found = {r["event_id"]: (r["rule"], r["active_event_count"], r["correlation_triggered"]) for r in correlate.correlate_rules(frame, [ssh, scan]).collect()}
    assert found == {0: ("ssh_bruteforce", 1, False), 1: ("scan", 1, False), 2: ("scan", 2, True), 3: ("ssh_bruteforce", 2, False),
                     4: (None, 0, False), 5: ("scan", 2, True)}
