"""Streams give what the batch operators give over the same rows."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import state
from quarryline.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet(EVENTS).orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def collected(spark, df, mode, name, tmp_path):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_windows(spark, folder, tmp_path):
    want = {tuple(r) for r in jobs.finding_windows(spark.read.parquet(folder), "event_type").collect()}
    got = {tuple(r) for r in collected(spark, jobs.finding_windows(jobs.event_stream(spark, folder), "event_type"), "complete", "windows", tmp_path).collect()}
    assert got == want and sum(r[3] for r in got) == spark.read.parquet(folder).count()


def test_sessions_in_batch(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "u int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.u, r.n) for r in jobs.finding_sessions(rows, "u").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_latest_state(spark, folder, tmp_path):
    columns = ["user_id", "event_id", "ts", "event_type"]
    want = {tuple(r) for r in state.latest(spark.read.parquet(folder).select(*columns), "user_id", "ts", "event_id").collect()}
    got = collected(spark, jobs.latest_state(jobs.event_stream(spark, folder).select(*columns), "user_id", "ts", "event_id"), "complete", "latest", tmp_path)
    assert {tuple(r) for r in got.collect()} == want


def test_repeats_go(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp")
    assert sorted(r.event_id for r in collected(spark, jobs.without_repeats(stream), "append", "repeats", tmp_path).collect()) == [1, 2]


def test_sliding_windows_and_sessions(spark, folder, tmp_path):
    rows, stream = spark.read.parquet(folder), jobs.event_stream(spark, folder)
    want = {tuple(r) for r in jobs.finding_windows(rows, "event_type", slide="30 minutes").collect()}
    got = collected(spark, jobs.finding_windows(stream, "event_type", slide="30 minutes"), "complete", "sliding", tmp_path)
    assert {tuple(r) for r in got.collect()} == want and sum(r[3] for r in want) == 2 * rows.count()
    want = {tuple(r) for r in jobs.finding_sessions(rows, "user_id", gap="6 hours").collect()}
    got = collected(spark, jobs.finding_sessions(jobs.event_stream(spark, folder), "user_id", gap="6 hours"), "complete", "sessions", tmp_path)
    assert {tuple(r) for r in got.collect()} == want


def test_jobs_run_once_over_a_restart(spark, tmp_path):
    """Requests arrive, the runner stops, more arrive, it goes on; a batch that is run again replaces itself."""
    import json

    from quarryline.operators import responder
    from quarryline.sources import sinks, tables

    where, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    where.mkdir()

    def arrive(name, ids):
        lines = [json.dumps({"request_id": i, "ts": "2024-01-01T00:00:00", "email": "a", "kind": "scan", "code": "raise-error" if i % 3 == 0 else f"x{i}", "filename": "f"}) for i in ids]
        (where / name).write_text("\n".join(lines))

    def run():
        query = jobs.run_jobs(jobs.request_stream(spark, str(where)), responder.stub("code"), out, checkpoint)
        query.processAllAvailable()
        query.stop()

    arrive("1.json", range(5))
    run()
    arrive("2.json", range(5, 9))
    run()
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.request_id, r.status) for r in rows) == [(i, "failed" if i % 3 == 0 else "completed") for i in range(9)]
    again = spark.createDataFrame([(r.request_id, r.status, r.report_text) for r in rows if r.batch == 0], "request_id long, status string, report_text string")
    sinks.append_once(out)(again, 0)
    assert spark.read.parquet(out).count() == 9
    assert tables.scan_requests(spark, str(where)).count() == 9
