"""Machines over streams give what the batch folds give, over restarts and out of order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarryline.operators import asof, state
from quarryline.streaming import machines

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "job_id long, event_id long, ts timestamp, move string, report string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    machines.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Runner:
    """A stream over a folder that files arrive in; each run is a restart from the checkpoint."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.where, self.schema, self.build, self.n = spark, tmp_path, schema, build, 0

    def run(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.where}/in")
            stream = self.spark.readStream.schema(self.schema).parquet(f"{self.where}/in")
            query = self.build(stream).writeStream.format("parquet").option("checkpointLocation", f"{self.where}/cp").outputMode("append").trigger(availableNow=True).start(f"{self.where}/out")
            query.awaitTermination()
        return self

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.where}/out").collect()))


def at(seconds):
    return START + timedelta(seconds=seconds)


def job_events(seed, n=250):
    rng = random.Random(seed)
    out, now = [], 0
    for i in range(n):
        now += rng.choice([0, 1, 30, 200, 4000])
        out.append((rng.randrange(6), i, at(now), rng.choice(["ask", "ask", "complete", "fail", "amend", None, "other"]), rng.choice([None, f"r{i}"])))
    return out, now


def test_jobs_against_the_batch_fold_over_restarts(spark, tmp_path):
    """Events reach the stream in any order within the lateness, in four runs; the last ones only push the watermark."""
    events, end = job_events(1)
    rng, shuffled = random.Random(2), sorted(events, key=lambda e: e[2] + timedelta(seconds=random.Random(e[1]).randrange(500)))
    cut = sorted(rng.sample(range(1, len(shuffled)), 3))
    parts = [shuffled[a:b] for a, b in zip([0, *cut], [*cut, len(shuffled)])]
    keep = 3000
    flush = [[(99, 10_000, at(end + 100_000), "ask", None)], [(99, 10_001, at(end + 200_000), "ask", None)]]
    runner = Runner(spark, tmp_path, EVENTS, lambda s: machines.job_transitions(s, keep_seconds=keep)).run(*parts, *flush)
    want = sorted(tuple(r) for r in state.job_transitions(spark.createDataFrame(events, EVENTS), keep_seconds=keep).collect())
    got = [r for r in runner.rows() if r[0] != 99]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(events)
    assert {r[3] for r in got} == {True, False}
    finished = [(r[0], r[1]) for r in want if r[3] and r[2] == "ask" and any(q[0] == r[0] and q[1] < r[1] and q[4] in ("completed", "failed") for q in want)]
    assert finished  # some were forgotten and asked for again


def test_the_fold_itself(spark):
    """By hand: what is allowed, what is not, and when a job is forgotten."""
    moves = [(0, "complete"), (1, "ask"), (2, "ask"), (3, "complete"), (4, "amend"), (5, "fail"), (14, "ask"), (15, "ask"), (16, "fail"), (17, "amend")]
    rows = [(1, i, at(t), m, f"{m}{t}") for i, (t, m) in enumerate(moves)] + [(2, 0, None, "ask", None), (None, 0, at(1), "ask", None)]
    got = state.job_transitions(spark.createDataFrame(rows, EVENTS), keep_seconds=10).orderBy("event_id").collect()
    assert [(r["legal"], r["status"], r["report"]) for r in got] == [
        (False, None, None), (True, "pending", "ask1"), (False, "pending", "ask1"), (True, "completed", "complete3"), (True, "completed", "amend4"),
        (False, "completed", "amend4"), (False, "completed", "amend4"), (True, "pending", "ask15"), (True, "failed", "fail16"), (False, "failed", "fail16"),
    ]


def test_quota_with_payments_against_the_as_of_join(spark, tmp_path):
    rng, rows, now = random.Random(3), [], 0
    for i in range(300):
        now += rng.choice([0, 20, 100])
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), at(now), rng.choices(["view", "click", "purchase"], [6, 2, 0.2])[0]))
    schema = "event_id long, user_id long, ts timestamp, kind string"
    df = spark.createDataFrame(rows, schema)
    paid = df.where("kind = 'purchase'").select("user_id", "ts", F.col("event_id").alias("payment"))
    requests = asof.as_of(df.where("kind <> 'purchase'"), paid, by=("user_id",), at="ts", carried=("payment",))
    terms = {"is_scan": F.col("kind") == "view", "used": F.col("user_id") % 3, "limit": 5}
    want = {(r["event_id"], r["accepted"]) for r in state.admitted_scans(requests, user="user_id", order=("ts", "event_id"), key="event_id", premium=F.col("payment").isNotNull(), **terms).collect()}
    build = lambda s: machines.quota(s, user="user_id", key="event_id", ts="ts", premium=F.lit(False), pays=F.col("kind") == "purchase", **terms)
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=random.Random(r[0]).randrange(300)))
    runner = Runner(spark, tmp_path, schema, build).run(late[:90], late[90:], [(1000, 9, at(now + 5000), "view")], [(1001, 9, at(now + 9000), "view")])
    assert {(r[1], r[2]) for r in runner.rows() if r[0] != 9} == want and {a for _, a in want} == {True, False}


def test_three_tries_at_the_right_times(spark, tmp_path):
    """The watermark is the clock: each file moves it on, and a run begins after each."""
    schema = "job_id long, ts timestamp, attempt int, error string, transient boolean"
    tick = lambda t: (0, at(t), 0, None, False)
    runner = Runner(spark, tmp_path, schema, machines.retries)
    fail = lambda job, t, attempt: (job, at(t), attempt, "down", True)
    runner.run([fail(1, 0, 0), fail(2, 0, 0), (3, at(0), 0, "bug", False), (4, at(1), 0, None, False), tick(50)])
    ends = lambda: sorted((r[0], r[1], r[2], (r[3].replace(tzinfo=timezone.utc) - START).seconds) for r in runner.rows() if r[0])
    assert ends() == [(3, "rejected", 0, 0), (4, "done", 0, 1)]  # 60 s are not over
    runner.run([tick(61)], [tick(70)])
    first = [(1, "try", 1, 60), (2, "try", 1, 60)]
    assert [r for r in ends() if r[1] == "try"] == first
    runner.run([fail(1, 80, 1), fail(1, 80, 1), (2, at(81), 1, None, False), tick(139)], [tick(141)], [tick(150)])
    assert [r for r in ends() if r[0] == 1] == [(1, "try", 1, 60), (1, "try", 2, 140)] and (2, "done", 1, 81) in ends()
    runner.run([fail(1, 160, 2), tick(221)], [tick(230)], [fail(1, 240, 3), tick(400)], [fail(1, 410, 4), tick(600)], [tick(700)])
    assert [r for r in ends() if r[0] == 1] == [(1, "dead", 3, 240), (1, "try", 1, 60), (1, "try", 2, 140), (1, "try", 3, 220)]
