from dataclasses import replace

from pyspark.sql import functions as F

from loghelm.operators import correlate as co
from loghelm.sources import readers, writers
from loghelm.streaming import jobs


def rows(spark, items):
    df = spark.createDataFrame(items, "event_id long, ts string, message string, prob_anomaly double")
    return df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.lit("h").alias("host"),
                     F.lit("sshd").alias("service"), "message", "prob_anomaly", F.lit(1).alias("pid"), F.lit("live").alias("source"))


def test_micro_batches_equal_the_batch_answer(spark, tmp_path):
    """Disordered arrivals, a restart from the checkpoint and a late row."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    first = [(i, f"2024-01-01 00:00:{s:02d}", f"ssh failure {i % 2} from 10.0.0.1", 0.1) for i, s in enumerate([30, 0, 12, 50, 20, 8, 41])]
    second = [(100 + i, f"2024-01-01 00:{m:02d}:00", f"ssh failure {i} from 10.0.0.1", 0.1) for i, m in enumerate([1, 3, 2, 3])]
    late = [(200, "2023-12-01 00:00:00", "ssh failure late from 10.0.0.1", 0.99)]
    end = [(300, "2024-02-01 00:00:00", "end", 0.0)]
    rule = replace(co.SSH_BRUTEFORCE, correlation_threshold=2)
    every = rows(spark, first + second)
    rows(spark, first).write.mode("append").parquet(src)
    jobs.live_job(jobs.new_rows(spark, src, every.schema), out, state, rule, "5 minutes")
    rows(spark, second).write.mode("append").parquet(src)
    jobs.live_job(jobs.new_rows(spark, src, every.schema), out, state, rule, "5 minutes")
    rows(spark, end).write.mode("append").parquet(src)
    jobs.live_job(jobs.new_rows(spark, src, every.schema), out, state, rule, "5 minutes")
    rows(spark, late).write.mode("append").parquet(src)
    jobs.live_job(jobs.new_rows(spark, src, every.schema), out, state, rule, "5 minutes")
    got = {(r["message"], r["timestamp"]): r["active_event_count"] for r in spark.read.parquet(out).collect()}
    want = {(r["message"], r["timestamp"]): r["active_event_count"]
            for r in co.correlate(every, rule).where("correlation_triggered").collect()}
    assert want and got == want


def test_one_source_sends_200_000_events_within_the_delay(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    n, scan = 200_000, co.CorrelationRule("port_scan", ("port scan",), 20, 5, 2)
    busy = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64("id"), F.lit(540_000_000)))
        .cast("timestamp_ntz").alias("timestamp"), F.lit("h").alias("host"), F.lit("sshd").alias("service"),
        F.concat(F.when(F.col("id") % 3 == 0, "port scan ").otherwise("failed password "), F.pmod(F.hash("id"), F.lit(60)), F.lit(" from 10.0.0.1"))
        .alias("message"), F.lit(0.1).alias("prob_anomaly"), F.lit(1).alias("pid"), F.lit("live").alias("source"))
    busy.repartition(4).write.parquet(src)
    rows(spark, [(-1, "2024-01-01 01:00:00", "end", 0.0)]).write.mode("append").parquet(src)
    stream = jobs.correlate_stream(jobs.new_rows(spark, src, busy.schema, files_per_batch=2), [co.SSH_BRUTEFORCE, scan], "10 minutes")
    jobs.run_available(stream.where("rule IS NOT NULL"), jobs.plain_sink(out), state)
    key = ["event_id", "rule", "active_event_count", "correlation_triggered"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*key).collect())
    want = sorted(tuple(r) for r in co.correlate_rules(busy, [co.SSH_BRUTEFORCE, scan]).where("rule IS NOT NULL").select(*key).collect())
    assert len(want) > 1000 and {r[1] for r in want} == {"ssh_bruteforce", "port_scan"} and got == want


def test_incremental_read_sees_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for i in range(2):
        spark.createDataFrame([(f"Jan 0{i + 1} 10:00:00 h s: m{i}",)], "value string").write.mode("append").text(src)
        jobs.run_available(jobs.parsed_tail(spark, src, F.lit("2024-06-01").cast("timestamp_ntz")), jobs.plain_sink(f"{out}/{i}"), state)
    counts = [spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{i}").count() for i in range(2)]
    assert counts == [1, 1]


def test_csv_skips_lines_of_the_wrong_width(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('h1,h2\n1,"a, ""b"""\n1,2,3\n,\nx,y\n')
    got = [tuple(r) for r in readers.csv_strings(spark, str(path)).collect()]
    assert got == [("1", 'a, "b"'), ("", ""), ("x", "y")]


def test_broken_json_documents_give_no_rows(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("action", T.StringType())])
    assert readers.json_documents(spark, str(tmp_path / "missing.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.json_documents(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "ok.json").write_text('[{"action": "closed"}, {"action": "x"}]')
    assert readers.json_documents(spark, str(tmp_path / "ok.json"), schema).count() == 2


def test_old_version_stays_after_replacing(spark, tmp_path):
    root = str(tmp_path / "t")
    df = rows(spark, [(1, "2024-01-01 00:00:00", "m", 0.1), (2, "2024-01-01 00:00:00", "m", 0.1)]).withColumn(
        "detected_at", F.col("timestamp"))
    writers.write_version(df, root, "1")
    writers.point_to(spark, root, "1", F.lit(1))
    assert writers.replace_deduplicated(spark, root, "2", F.lit(2), ["event_id"]).count() == 1
    assert spark.read.parquet(f"{root}/v=1").count() == 2


def test_csv_export_quotes(spark, tmp_path):
    out = str(tmp_path / "e")
    df = spark.createDataFrame([('say "hi"', None)], "a string, b string")
    writers.export_csv(df.coalesce(1), out)
    body = "".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))
    assert body == 'a,b\n"say ""hi""",""\n' or body == '"a","b"\n"say ""hi""",""\n'


def test_a_running_job_picks_up_the_promoted_version(spark, tmp_path):
    """Keyword scores before the first version, then each batch's own version; a failed gate moves nothing."""
    import time

    from loghelm.operators.ml import models, retrain, stages
    src, out, state, root = (str(tmp_path / n) for n in ("src", "out", "state", "root"))
    items = [(i, "2024-01-01 00:00:00", f"failed password {i}" if i % 2 else f"block served {i}", 0.1) for i in range(80)]
    train = rows(spark, items).select(F.col("event_id").alias("id"), "message", (F.col("event_id") % 2).cast("int").alias("label"))
    features = stages.fit_features(train, max_features=30)
    prepared = stages.featurise(train, features).select("id", "label", "features").persist()
    parts = {}
    for version, trees in (("1", 3), ("2", 7), ("3", 5)):
        model = models.calibrate(prepared if version != "2" else prepared.withColumn("label", 1 - F.col("label")), "random_forest", "id", 2, numTrees=trees)
        retrain.save_version(features, model, root, version)
        parts[version] = model
    every = rows(spark, items).drop("prob_anomaly")

    def send(low):
        every.where(f"event_id >= {low} AND event_id < {low + 20}").coalesce(1).write.mode("append").parquet(src)
        for _ in range(240):
            query.processAllAvailable()
            found = spark.read.option("recursiveFileLookup", True).parquet(out) if list((tmp_path / "out").glob("batch=*")) else None
            if found is not None and found.where(f"event_id >= {low}").count() == 20:
                return found.where(f"event_id >= {low}").collect()
            time.sleep(0.25)
        raise AssertionError("no batch came")
    every.limit(0).write.parquet(src)
    query = jobs.run_every(jobs.new_rows(spark, src, every.schema), jobs.scoring_sink(root, out), state, 0.5)
    try:
        assert {r["model_version"] for r in send(0)} == {"keywords"}
        for low, version in ((20, "1"), (40, "2")):
            writers.point_to(spark, f"{root}/models", version, F.lit(version))
            got = {r["event_id"]: (r["model_version"], r["prob_anomaly"]) for r in send(low)}
            want = parts[version].transform(stages.featurise(every.where(f"event_id >= {low} AND event_id < {low + 20}"), features)).collect()
            assert got == {r["event_id"]: (version, r["score"]) for r in want}
        assert {r["model_version"] for r in send(60)} == {"2"}  # version 3 is saved, not promoted
    finally:
        query.stop()


def test_new_records_over_restarts_and_a_cold_start(spark, tmp_path):
    """A restart from the checkpoint, then a job without one that reads the stored table, equal the batch answer."""
    from loghelm.operators import dedup
    from loghelm.streaming import newest
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    every = rows(spark, [(i, "2024-01-01 00:00:00", f"message {i * 7 % 23}", 0.1) for i in range(90)])
    for run, (low, state) in enumerate(((0, "a"), (30, "a"), (60, "b"))):
        part = src if state == "a" else src + "-later"
        every.where(f"event_id >= {low} AND event_id < {low + 30}").coalesce(1).write.mode("append").parquet(part)
        stored = spark.read.option("recursiveFileLookup", True).parquet(out) if state == "b" else None
        fresh = newest.new_records(jobs.new_rows(spark, part, every.schema), stored, "event_id")
        jobs.run_available(fresh, jobs.plain_sink(f"{out}/{state}"), str(tmp_path / f"state-{state}"))
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    want = dedup.first_records(every, ["event_id"])
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())
    assert set(got.columns) == set(every.columns)
    later = rows(spark, [(200 + i, "2024-01-02 00:00:00", f"message {i}", 0.1) for i in range(3)])
    short = lambda: newest.new_records(jobs.new_rows(spark, src, every.schema), None, "event_id", 60, "1 minute")
    for part in (None, later, later.withColumn("event_id", F.col("event_id") + 100)):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(short(), jobs.plain_sink(str(tmp_path / "short")), str(tmp_path / "state-short"))
    again = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "short"))
    assert sorted(r["event_id"] for r in again.where("event_id >= 200").collect()) == [200, 201, 202]


def test_streams_run_in_a_session_with_the_default_state_store(spark, tmp_path):
    """The default store can't hold keyed state with timers; the session's own setting is left as it was."""
    plain, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    plain.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    every = rows(plain, [(1, "2024-01-01 00:00:00", "ssh failure 1 from 10.0.0.1", 0.9), (2, "2024-02-01 00:00:00", "end", 0.0)])
    every.coalesce(1).write.parquet(src)
    jobs.live_job(jobs.new_rows(plain, src, every.schema), out, state)
    assert [r["message"] for r in plain.read.parquet(out).collect()] == ["ssh failure 1 from 10.0.0.1"]
    assert plain.conf.get(key).endswith("HDFSBackedStateStoreProvider")
