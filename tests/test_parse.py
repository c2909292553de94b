import datetime as dt

from pyspark.sql import functions as F

from loghelm.functions import text
from loghelm.operators import parse
from loghelm.sources import readers


def parsed(spark, lines, ref):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    out = parse.parse_syslog(df, F.lit(ref).cast("timestamp_ntz"))
    return {r["i"]: r for r in out.collect()}


def test_syslog_lines(spark):
    rows = parsed(spark, [
        "Jan 05 10:00:01 web1 sshd[77]: Failed password",
        "Jan  5 10:00:01 web1 my service: hello: there",
        "not a log line",
        "",
        "  Mar 01 00:00:00 h cron[1]: x  ",
    ], "2024-06-01 00:00:00")
    assert set(rows) == {0, 1, 4}
    assert rows[0]["pid"] == 77 and rows[0]["service"] == "sshd" and rows[0]["message"] == "Failed password"
    assert rows[1]["pid"] == -1 and rows[1]["service"] == "my service" and rows[1]["message"] == "hello: there"
    assert rows[4]["message"] == "x"


def test_year_is_inferred(spark):
    ref = "2025-01-01 08:00:00"
    rows = parsed(spark, [
        "Dec 31 23:59:59 h s: last year",
        "Jan 01 07:59:59 h s: today",
        "Feb 29 10:00:00 h s: no such day",
        "Xxx 10 10:00:00 h s: no such month",
        "Jan 01 25:00:00 h s: no such hour",
        "Jan 01 07:00:60 h s: no such second",
    ], ref)
    now = dt.datetime(2025, 1, 1, 8)
    assert rows[0]["timestamp"] == dt.datetime(2024, 12, 31, 23, 59, 59)
    assert rows[1]["timestamp"] == dt.datetime(2025, 1, 1, 7, 59, 59)
    assert all(rows[i]["timestamp"] == now for i in (2, 3, 4, 5))


def test_leap_day_is_read_in_a_leap_year(spark):
    rows = parsed(spark, ["Feb 29 10:00:00 h s: leap"], "2024-03-01 00:00:00")
    assert rows[0]["timestamp"] == dt.datetime(2024, 2, 29, 10)


def test_bracketed(spark):
    df = spark.createDataFrame([("[2024-01-01 10:00] ERROR: lost 10.1.2.3",), ("[x] WARN: nothing",)], "value string")
    rows = parse.parse_bracketed(df).collect()
    assert tuple(rows[0]) == ("2024-01-01 10:00", "ERROR", "10.1.2.3")
    assert tuple(rows[1]) == ("x", "WARN", "N/A")


def test_service_names(spark):
    df = spark.createDataFrame([(" SSSHD ",), ("ssh",), ("Cron",)], "s string")
    assert [r[0] for r in df.select(parse.canonical_service(F.col("s"))).collect()] == ["sshd", "sshd", "cron"]


def test_json_lines_that_break_are_left_out(spark):
    df = spark.createDataFrame([('{"message": "a", "prob_anomaly": "0.7"}',), ("{broken}",), ("plain",)], "value string")
    rows = parse.json_events(df, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert len(rows) == 1
    assert rows[0]["host"] == "unknown" and rows[0]["prob_anomaly"] == 0.7 and rows[0]["source"] == "upload"
    assert rows[0]["timestamp"] == "2024-01-01T00:00:00Z"


def test_trace_files(spark, tmp_path):
    for name, body in {"Training/a.txt": b"1 2\n3", "Attack/x/b.txt": b"4  5", "Validation/c.txt": "caf\xe9".encode("latin-1"), "d.log": b"no"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    rows = {r["filepath"]: r for r in parse.parse_traces(readers.trace_files(spark, str(tmp_path / "root"))).collect()}
    assert set(rows) == {"Training/a.txt", "Attack/x/b.txt", "Validation/c.txt"}
    assert rows["Training/a.txt"]["message"] == "1 2 3" and rows["Training/a.txt"]["split"] == "TRAINING"
    assert rows["Attack/x/b.txt"]["is_anomaly"] == 1 and rows["Attack/x/b.txt"]["split"] == "ATTACK"
    assert rows["Validation/c.txt"]["message"] == "café" and rows["Validation/c.txt"]["split"] == "VALIDATE"


def test_short_lines_keep_their_text_when_retimed(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",)], "v string")
    got = [r[0] for r in df.select(parse.retime(F.col("v"), F.lit("2024-03-05 06:07:08").cast("timestamp_ntz"))).collect()]
    assert got == ["Mar 05 06:07:08 d e", "Mar 05 06:07:08 a b"]


def test_truncation(spark):
    df = spark.createDataFrame([("x" * 9000,), ("y" * 8000,)], "v string")
    got = [r[0] for r in df.select(text.truncate(F.col("v"))).collect()]
    assert got == ["x" * 8000 + " ...[truncated]", "y" * 8000]
