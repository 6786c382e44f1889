import datetime

from pyspark.sql import functions as F

from millrace.streaming import events as S


def stream(spark, tmp_path, rows, schema):
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    return spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)


def run(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def ts(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def test_debounce(spark, tmp_path):
    rows = [("p", "src/a.ts", ts(0)), ("p", "src/a.ts", ts(20)), ("p", "node_modules/x", ts(45)), ("p", "src/b.ts", ts(60)), ("p", "src/z.ts", ts(9000))]
    got = run(S.debounce_changes(stream(spark, tmp_path, rows, "project_id string, path string, ts timestamp")), tmp_path, "append", "debounced")
    assert sorted((r.fire_at, r.changes) for r in got) == [(ts(50), 2), (ts(90), 1)]  # the last session is still open


def test_coalesced_progress(spark, tmp_path):
    assert S.coalesced([(0, "a", 1.0), (100, "a", 2.0), (600, "a", 3.0), (700, "a", 4.0), (750, "b", 1.0)], None, None, 500) == ([(0, "a", 1.0), (600, "a", 3.0), (700, "a", 4.0), (750, "b", 1.0)], (750, "b", 1.0), None)
    rows = [("p", ts(0), "a", 1.0), ("p", ts(0.1), "a", 2.0), ("p", ts(0.7), "a", 3.0), ("p", ts(0.8), "b", 0.0), ("q", ts(0), "a", 1.0)]
    got = run(S.coalesce_progress(stream(spark, tmp_path, rows, "project_id string, ts timestamp, phase string, done double")), tmp_path, "append", "coalesced")
    assert sorted((r.project_id, r.phase, r.done) for r in got) == [("p", "a", 1.0), ("p", "a", 3.0), ("p", "b", 0.0), ("q", "a", 1.0)]


def test_status_and_requests(spark, tmp_path):
    rows = [("p", "j1", "running", ts(0)), ("p", "j1", "succeeded", ts(5)), ("q", "j2", "queued", ts(1))]
    got = run(S.latest_status(stream(spark, tmp_path / "a", rows, "project_id string, job_id string, status string, ts timestamp")), tmp_path / "a", "complete", "status")
    assert {(r.project_id, r.status, r.done) for r in got} == {("p", "succeeded", True), ("q", "queued", False)}
    rows = [("p", "r1", ts(0)), ("p", "r1", ts(5)), ("p", "r2", ts(6))]
    got = run(S.dedupe_requests(stream(spark, tmp_path / "b", rows, "project_id string, revision string, ts timestamp")), tmp_path / "b", "append", "requests")
    assert sorted(r.revision for r in got) == ["r1", "r2"]


def test_quota_heads_and_throttle(spark, tmp_path):
    rows = [("p", 50, ts(0)), ("p", 11, ts(30)), ("p", 5, ts(70))]
    df = spark.createDataFrame(rows, "project_id string, requests int, ts timestamp")
    assert sorted((r.requests, r.over) for r in S.request_quota(df).collect()) == [(5, False), (61, True)]
    polls = stream(spark, tmp_path, [("p", "a", ts(0)), ("p", "b", ts(1))], "project_id string, revision string, ts timestamp")
    assert [r.revision for r in run(S.head_moved(polls, spark.createDataFrame([("p", "a")], "project_id string, head_revision string")), tmp_path, "append", "heads")] == ["b"]
    ups = spark.createDataFrame([("p", i, "a", float(i), ts(i / 10)) for i in range(10)], "project_id string, event_id int, phase string, done double, ts timestamp")
    assert sorted(r.event_id for r in S.throttle_progress(ups).collect()) == [2, 4, 7, 9]


def test_incremental_index(spark, tmp_path):
    from millrace.operators.indexing import build_chunks

    files = stream(spark, tmp_path, [("p", "a.txt", "x\ny\n")], "project_id string, path string, text string")
    q = S.incremental_index(files, lambda batch, _: build_chunks(batch).write.mode("append").parquet(f"{tmp_path}/chunks"), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/chunks").select(F.col("content")).first().content == "x\ny"


def test_coalesced_progress_takes_null_phases(spark, tmp_path):
    rows = [("p", ts(0), None, 1.0), ("p", ts(0), "a", 2.0), ("p", ts(0.1), None, None), ("p", ts(0.2), None, 3.0), ("q", None, "a", 1.0)]
    schema = "project_id string, ts timestamp, phase string, done double"
    got = run(S.coalesce_progress(stream(spark, tmp_path, rows, schema)), tmp_path, "append", "coalesced_nulls")
    assert [(r.project_id, r.phase) for r in got] == [("p", None), ("p", "a"), ("p", None)]
