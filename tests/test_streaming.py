"""Streams equal their batch twins on finite inputs."""

import os

import pytest
from pyspark.sql import functions as F

from storyloom.streaming import jobs

DATA = "/root/testdata/sf0.001"


def stream(spark, tmp_path, rows, schema, name):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def test_usage_windows(spark, tmp_path):
    rows = [(i % 3, "k", i * 600) for i in range(60)]
    df, live = stream(spark, tmp_path, rows, "user_id int, kind string, sec int", "u")
    at = F.timestamp_seconds("sec")
    got = jobs.run_to_memory(spark, jobs.usage_windows(live.withColumn("ts", at)), "usage_windows", str(tmp_path / "c1"), "complete")
    want = df.groupBy(F.window(at, "1 hour").alias("w"), "user_id", "kind").count()
    assert sorted((r.user_id, str(r.start), r.n) for r in got.collect()) == sorted((r.user_id, str(r.w.start), r["count"]) for r in want.collect())


def test_alias_links_once(spark, tmp_path):
    rows = [(1, 1, "a", 5), (1, 1, "a", 6), (1, 2, "a", 7), (1, 1, "b", 8)]
    _, live = stream(spark, tmp_path, rows, "world_id long, entity_id long, alias string, sec int", "a")
    got = jobs.run_to_memory(spark, jobs.alias_links(live.withColumn("ts", F.timestamp_seconds("sec"))), "alias_links", str(tmp_path / "c2"))
    assert sorted((r.world_id, r.entity_id, r.alias) for r in got.collect()) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a")]


def test_silent_runs(spark, tmp_path):
    rows = [("r", 0), ("r", 60), ("r", 300)]
    _, live = stream(spark, tmp_path, rows, "run_id string, sec int", "h")
    got = jobs.run_to_memory(spark, jobs.silent_runs(live.withColumn("ts", F.timestamp_seconds("sec"))), "silent_runs", str(tmp_path / "c3"), "complete")
    assert sorted(r.beats for r in got.collect()) == [1, 2]


def test_denial_spike_resets(spark, tmp_path):
    rows = [(1, s) for s in (0, 1, 2, 3, 400, 401, 402)] + [(2, 0), (2, 500)]
    _, live = stream(spark, tmp_path, rows, "key long, sec long", "d")
    got = jobs.run_to_memory(spark, jobs.denial_spikes(live, most=3, window=300), "denial_spikes", str(tmp_path / "c4"))
    assert sorted((r.key, r.sec) for r in got.collect()) == [(1, 2), (1, 402)]


def test_failed_runs(spark, tmp_path):
    rows = [(1, 0, False), (1, 60, False), (2, 0, False), (2, 30, True), (3, 9000, False)]
    _, live = stream(spark, tmp_path, rows, "run_id long, sec long, finished boolean", "f")
    got = jobs.run_to_memory(spark, jobs.failed_runs(live.withColumn("ts", F.timestamp_seconds("sec"))), "failed_runs", str(tmp_path / "c5"))
    assert [(r.run_id, r.failed_at.minute, r.status) for r in got.collect()] == [(1, 2, "failed")]


def test_run_ledger_continues(spark, tmp_path):
    """Numbers go on where the last batch ended; the batch twin agrees."""
    from storyloom.operators.lifecycle import ledger

    schema = "run_id long, event_id long, sec long"
    first, second = [(i % 2, i, i) for i in range(6)], [(i % 2, i, i) for i in range(6, 11)]
    _, live = stream(spark, tmp_path, first, schema, "l")
    table = jobs.run_to_memory(spark, jobs.run_ledger(live), "run_ledger", str(tmp_path / "c6"))
    assert table.count() == 6
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    q = jobs.run_ledger(live).writeStream.format("parquet").option("path", str(tmp_path / "l2")).option("checkpointLocation", str(tmp_path / "c7")).option("maxFilesPerTrigger", 1).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "l2"))
    want = ledger(spark.createDataFrame(first + second, schema).withColumnRenamed("sec", "ts"))
    assert sorted((r.run_id, r.event_id, r.seq) for r in got.collect()) == sorted((r.run_id, r.event_id, r.seq) for r in want.collect())


def test_cost_guard(spark, tmp_path):
    from storyloom.operators import usage

    rows = [(1, 1, 1, 4.0), (1, 2, 2, 4.0), (1, 3, 3, 4.0), (1, 4, 4, 4.0), (2, 5, 1, 10.0), (3, 6, 1, 11.0)]
    df, live = stream(spark, tmp_path, rows, "run_id long, event_id long, sec long, cost double", "g")
    got = jobs.run_to_memory(spark, jobs.cost_guard(live, 10.0), "cost_guard", str(tmp_path / "c8"))
    want = usage.cost_guard(df.withColumnRenamed("sec", "ts"), 10.0)
    assert sorted(map(tuple, got.collect())) == sorted((r.run_id, r.event_id, r.total) for r in want.collect()) == [(1, 3, 12.0), (3, 6, 11.0)]


def test_sliding_quota(spark, tmp_path):
    from storyloom.operators import usage

    rows = [(1, "a", i, s) for i, s in enumerate((0, 10, 59, 60, 61, 200))] + [(1, "b", 9, 0), (2, "a", 10, 5)]
    df, live = stream(spark, tmp_path, rows, "user_id long, kind string, event_id long, sec long", "q")
    got = jobs.run_to_memory(spark, jobs.sliding_quota(live, {"a": 2}, 60), "sliding_quota", str(tmp_path / "c9"))
    limits = spark.createDataFrame([("a", 2)], "kind string, `limit` int")
    want = usage.quota(df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec"), limits, 60)
    assert sorted((r.user_id, r.event_id, r.used, r.denied) for r in got.collect()) == sorted((r.user_id, r.event_id, r.used, r.denied) for r in want.collect())
    assert {r.event_id for r in got.collect() if r.denied} == {2, 3, 4}


def test_stays(spark, tmp_path):
    """Closed, skipped, conflicting and anchored rows are the batch fold's; what comes too late is set aside."""
    from storyloom.operators.folds import interval_fold

    schema = "world_id long, subject_id long, assertion_id long, object_id long, position int, starts boolean"
    rows = [(1, 1, 1, 7, 0, True), (1, 1, 2, 7, 1, True), (1, 1, 3, 8, 2, True), (1, 1, 4, 9, 2, True), (1, 1, 5, 7, 5, True), (1, 1, 6, 8, 3, False), (1, 1, 7, 8, None, True), (1, 2, 8, 7, 4, True)]
    df, live = stream(spark, tmp_path, rows, schema, "s")
    got = jobs.run_to_memory(spark, jobs.stays(live), "stays", str(tmp_path / "c10"))
    want = interval_fold(df).filter("action != 'open'")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    late = [(1, 1, 9, 9, 1, True), (1, 2, 10, 9, 6, True)]
    for name, part in (("s2/a", rows), ("s2/b", late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name))
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "s2"))
    more = jobs.run_to_memory(spark, jobs.stays(again), "stays_again", str(tmp_path / "c11"))
    assert {(r.assertion_id, r.action) for r in more.collect()} - {(r.assertion_id, r.action) for r in got.collect()} == {(9, "late"), (8, "closed")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_new_findings_once(spark, tmp_path):
    from storyloom.operators.checks import run_checks
    from storyloom.sources.graph import derive

    g = derive(spark, DATA)
    g.assertions.select("world_id", "assertion_id").coalesce(1).write.parquet(str(tmp_path / "n"))
    live = spark.readStream.schema("world_id long, assertion_id long").parquet(str(tmp_path / "n"))
    folder = str(tmp_path / "ledger")
    counts = []
    for k in range(2):
        jobs.stream_new_findings(live, lambda worlds: g, folder, str(tmp_path / f"n{k}")).awaitTermination()
        counts.append(spark.read.parquet(folder).count())
    want = run_checks(g)[0].filter(~F.col("sealed")).select(*jobs.KEY).distinct().count()
    assert counts == [want, want] and want > 0
    assert all(r.first and r.kind == "found" for r in spark.read.parquet(folder).collect())


def test_findings_are_retracted_and_the_first_are_marked(spark, tmp_path):
    """After each micro-batch what stands in the ledger is what the batch checks find."""
    from storyloom.operators.checks import run_checks
    from test_graph import graph

    rows = [(1, 1, 1, "dies", None, None, True, 3, None, 103, "canon"), (2, 2, 1, "dies", None, None, True, 3, None, 203, "canon")]
    steps = [(rows[:1], [1]), ([*rows, (3, 1, 2, "dies", None, None, True, 2, None, 102, "canon")], [1, 2]), ([(*rows[0][:10], "sealed"), rows[1]], [1])]
    seen, folder, kinds = [(1, 6, 1), (1, 6, 2), (2, 6, 1)], str(tmp_path / "ledger"), []
    for k, (facts, touched) in enumerate(steps):
        g = graph(spark, facts, seen)
        spark.createDataFrame([(w, k) for w in touched], "world_id long, assertion_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        live = spark.readStream.schema("world_id long, assertion_id long").parquet(str(tmp_path / "r"))
        jobs.stream_new_findings(live, lambda worlds, g=g: g, folder, str(tmp_path / "rc"), ["dead_speaker"]).awaitTermination()
        ledger = spark.read.schema(jobs.LEDGER).parquet(folder)
        want = run_checks(g, ["dead_speaker"])[0].select(*jobs.KEY).distinct()
        assert sorted(map(tuple, jobs.live_findings(ledger).select(*jobs.KEY).collect())) == sorted(map(tuple, want.collect()))
        kinds.append({(r.world_id, r.kind, r.first) for r in ledger.filter(f"batch = {k}").collect()})
    assert kinds == [{(1, "found", True)}, {(1, "found", False), (2, "found", True)}, {(1, "retracted", False)}]


def wait_for(done, seconds=60):
    import time

    until = time.time() + seconds
    while not done() and time.time() < until:
        time.sleep(0.3)
    assert done()


def test_a_silent_run_fails_by_the_clock(spark, tmp_path):
    """No later beat is needed, a finished run doesn't fail, and neither leaves state."""
    _, live = stream(spark, tmp_path, [(1, False), (2, False), (2, True), (3, False)], "run_id long, finished boolean", "w")
    q = jobs.watched_runs(live, 2000).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "cw")).trigger(processingTime="500 milliseconds").start()
    try:
        wait_for(lambda: spark.table("watched").count() == 2)
    finally:
        q.stop()
    assert sorted((r.run_id, r.status) for r in spark.table("watched").collect()) == [(1, "failed"), (3, "failed")]
    assert spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "cw")).count() == 0


def test_finished_runs_leave_no_state(spark, tmp_path):
    rows = [(1, 1, 1, False), (1, 2, 2, True), (2, 3, 1, False)]
    _, live = stream(spark, tmp_path, rows, "run_id long, event_id long, sec long, finished boolean", "e")
    got = jobs.run_to_memory(spark, jobs.run_ledger(live), "ended", str(tmp_path / "ce"))
    assert sorted((r.run_id, r.seq) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "ce"))
    assert [r.key.run_id for r in held.collect()] == [2]


def test_state_expires(spark, tmp_path):
    """A run of which nothing comes for a second of the clock begins anew."""
    folder = tmp_path / "t"
    kind = "run_id long, event_id long, sec long"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(folder))
    put([(1, 1, 1), (1, 2, 2)])
    q = jobs.run_ledger(spark.readStream.schema(kind).parquet(str(folder)), ttl=1000).writeStream.format("memory").queryName("aged").outputMode("append").option("checkpointLocation", str(tmp_path / "ct")).trigger(processingTime="300 milliseconds").start()
    try:
        wait_for(lambda: spark.table("aged").count() == 2)
        import time

        time.sleep(3)
        put([(1, 3, 3)])
        wait_for(lambda: spark.table("aged").count() == 3)
    finally:
        q.stop()
    assert [r.seq for r in spark.table("aged").orderBy("event_id").collect()] == [1, 2, 1]


def test_last_stays_and_late_rows_equal_the_batch_fold(spark, tmp_path):
    from storyloom.operators.folds import interval_fold

    kind = "world_id long, subject_id long, assertion_id long, object_id long, position int, starts boolean, sec long"
    parts = [[(1, 1, 1, 7, 0, True, 0), (1, 1, 3, 8, 4, True, 10), (1, 2, 4, 7, 1, True, 10)], [(1, 1, 2, 9, 2, True, 20), (1, 2, 5, 8, 3, True, 20)], [(1, 3, 6, 7, 1, True, 100_000)], [(1, 4, 7, 7, 1, True, 200_000)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"z/{k}"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "z"))
    live = live.withColumn("ts", F.timestamp_seconds("sec")).withWatermark("ts", "10 seconds")
    got = jobs.run_to_memory(spark, jobs.stays(live, patience=60_000), "last_stays", str(tmp_path / "cz"))
    rows = spark.createDataFrame([r for p in parts[:2] for r in p], kind)
    mine = jobs.settled(rows.drop("sec"), got.filter("subject_id < 3"))
    want = interval_fold(rows.drop("sec"))
    assert sorted(map(str, mine.collect())) == sorted(map(str, want.select(mine.columns).collect()))
    assert {r.action for r in got.filter("subject_id = 1").collect()} >= {"late", "open"}
