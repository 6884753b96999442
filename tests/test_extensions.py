"""Sketches, interval joins, differences of ingests, reads by quantiles, the outbox, streams of requests and ends."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarryline.functions import reports
from quarryline.operators import difference, intervals, sketches
from quarryline.plans import workflows
from quarryline.sources import outbox, tables
from quarryline.streaming import jobs

# ---------------------------------------------------------------- sketches


def test_sketches_of_many_codes_are_within_their_errors(spark):
    """300,000 codes in ten groups that overlap: combined sketches against the exact numbers."""
    rows = spark.range(600_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 300_000).cast("string").alias("code"), (F.col("id") % 100_000).alias("size"))
    kept = sketches.sketched(rows, "day", code="code", size="size")
    whole = sketches.estimates(sketches.combined(kept.withColumn("all", F.lit(1)), "all"), "all").first()
    assert whole["n"] == 600_000 and abs(whole["n_codes"] / 300_000 - 1) < 4 * sketches.THETA_ERROR and abs(whole["n_codes_hll"] / 300_000 - 1) < 4 * sketches.HLL_ERROR
    assert abs(whole["size_quantile"] / 100_000 - 0.5) < sketches.KLL_ERROR
    first = kept.where("day < 5").withColumn("half", F.lit(0))
    both = sketches.combined(first.unionByName(kept.where("day >= 3").withColumn("half", F.lit(1))), "half")
    got = sketches.not_in(both, both.where("half = 1")).where("half = 0").first()
    assert abs(got["n_not_in"] - 90_000) < 4 * sketches.THETA_ERROR * 300_000 and abs(got["n_common"] - 60_000) < 4 * sketches.THETA_ERROR * 300_000


def test_small_sketches_are_exact(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 5), ("a", "x", None), ("b", None, None)], "k string, code string, size int")
    got = {r["k"]: tuple(r)[1:] for r in sketches.estimates(sketches.sketched(rows, "k", code="code", size="size").where("k = 'a'"), "k").collect()}
    assert got == {"a": (3, 1, 1, 1)}


@pytest.mark.parametrize("names", [("en", "de"), ("de", "fr")])
def test_codes_of_a_language_are_exact(spark, tmp_path, names):
    """30,000 documents of each of two languages, beyond what a sketch holds exactly; nulls; with English and without."""
    i, second = F.col("id"), F.col("id") >= 30_000
    lang = F.when(i % 1000 != 0, F.when(second, names[1]).otherwise(names[0]))
    rows = spark.range(60_000).select(lang.alias("lang"), (i % 3).cast("string").alias("source"), F.when(~second | (i % 7 != 0), (i % 40_000).cast("string")).alias("text"), F.when(i % 11 != 0, i * i % 30_011).alias("n_chars"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["lang"]: tuple(r)[1:] for r in workflows.distinct_codes(spark, str(tmp_path)).collect()}
    plain = {name: [r for r in rows.collect() if r["lang"] == name] for name in names}
    codes = {name: {r["text"] for r in plain[name]} - {None} for name in names}
    size = lambda name: sorted(r["n_chars"] for r in plain[name] if r["n_chars"] is not None)
    middle = {name: size(name)[(len(size(name)) + 1) // 2 - 1] for name in names}
    english = codes.get("en", set())
    assert got == {name: (len(plain[name]), len(codes[name]), len(codes[name]), middle[name], len(codes[name] - english), len(codes[name] & english)) for name in names}


def test_no_code_is_known_to_be_beyond_a_null(spark):
    rows = spark.createDataFrame([("en", None, 1), ("en", "x", 1), ("de", "x", 1), ("de", "y", None), ("fr", None, None)], "lang string, code string, size int")
    got = {r["lang"]: tuple(r)[1:] for r in sketches.exact(sketches.counted(rows, "lang", code="code", size="size"), "lang", other="en").collect()}
    assert got == {"en": (2, 1, 1, 0, 1), "de": (2, 2, 1, 0, 1), "fr": (1, 0, None, 0, 0)}


# ---------------------------------------------------------------- intervals


@pytest.mark.parametrize("unit", [1, 7])
def test_overlaps_against_all_pairs(spark, unit):
    """Short and very long intervals, empty ones, nulls, negative starts, a hot key."""
    rng = random.Random(unit)

    def side(n):
        out = []
        for i in range(n):
            a = rng.randrange(-300, 300)
            out.append((rng.choice(["k", "k", "l", None]), i, rng.choice([a, a, a, None]), a + rng.choice([0, -1, 1, 3, 16, 17, 200, 100_000])))
        return out

    left, right = side(120), side(100)
    got = intervals.overlaps(spark.createDataFrame(left, "k string, l int, a long, b long"), spark.createDataFrame(right, "k string, r int, c long, d long"), by=("k",), start=("a", "c"), end=("b", "d"), unit=unit)
    want = [(k, i, a, b, j, c, d) for k, i, a, b in left for q, j, c, d in right if k is not None and k == q and a is not None and c is not None and a < b and c < d and a < d and c < b]
    assert got.columns == ["k", "l", "a", "b", "r", "c", "d"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_intervals_are_looked_up_in_classes_that_are_there(spark, tmp_path):
    """5,000 intervals of one class on each side: some two copies of each are shuffled, not two for every class that there could be."""
    side = lambda name, a, b: spark.range(5000).select((F.col("id") % 100).alias("k"), F.col("id").alias(name), F.col("id").alias(a), (F.col("id") + 1000).alias(b))
    before = max((s.stageId() for s in stages(spark)), default=-1)
    intervals.overlaps(side("l", "a", "b"), side("r", "c", "d").hint("merge"), by=("k",), start=("a", "c"), end=("b", "d")).write.parquet(str(tmp_path / "o"))
    assert sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() > before) < 40_000


def test_sessions_are_intervals_of_their_whole_length(spark):
    """Sessions of one to nine hours straight from their grouping, against all pairs."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, start + timedelta(hours=20 * s, minutes=50 * m)) for k in range(3) for s in range(5) for m in range(1 + (k + 2 * s) % 10)]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = spark.createDataFrame(rows, "k int, ts timestamp")
    sessions = jobs.finding_sessions(events, "k", gap="1 hour").select("k", micros("session_start").alias("a"), micros("session_end").alias("b"))
    points = events.select("k", micros("ts").alias("c"), (micros("ts") + 60_000_000).alias("d"))
    got = intervals.overlaps(sessions, points, by=("k",), start=("a", "c"), end=("b", "d"), unit=3_600_000_000).select("k", "a", "c")
    want = [(k, a, c) for k, a, b in map(tuple, sessions.collect()) for q, c, d in map(tuple, points.collect()) if k == q and a < d and c < b]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == len(rows)


def stages(spark):
    context = spark.sparkContext
    return spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None))


# ---------------------------------------------------------------- differences


def test_difference_of_multisets(spark):
    rng = random.Random(5)
    draw = lambda n: [(rng.choice(["a", "b", None]), rng.randrange(5), "x") for _ in range(n)]
    one, two = draw(200), draw(190)
    frame = lambda rows: spark.createDataFrame(rows, "v string, n int, bucket string").repartition(3)
    got = {tuple(r)[:3]: r[3] for r in difference.difference(frame(one), frame(two), buckets=8).collect()}
    left = Counter(one)
    left.subtract(Counter(two))
    assert got == {k: n for k, n in left.items() if n}
    assert difference.difference(frame(one), frame(one[::-1])).count() == 0
    assert difference.difference(frame(one).limit(0), frame(two), buckets=4).agg(F.sum("n_")).first()[0] == -190


def test_equal_buckets_are_not_compared(spark):
    one = spark.range(10_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    two = one.withColumn("h", F.when(F.col("id") == 77, F.lit("changed")).otherwise(F.col("h")))
    assert difference.open_buckets(one, two, 512).count() <= 2
    assert sorted(map(tuple, difference.difference(one, two).select("id", "n").collect())) == [(77, -1), (77, 1)]


# ---------------------------------------------------------------- JDBC


def test_reads_by_quantiles(spark, tmp_path):
    """Skewed keys and nulls: no read of over twice the middle, none twice; ranges of equal width would put nearly all in one."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    i = F.col("id")
    rows = spark.range(5000).select(F.when(i % 50 != 0, i * i * i).alias("k"), i.alias("v"), F.concat(F.lit("n'"), i.cast("string")).alias("name"))
    rows.write.format("jdbc").options(url=url, dbtable="skewed", driver=driver, createTableColumnTypes="name VARCHAR(20)").save()
    for key in ("k", "name"):
        parts = tables.database_by_quantiles(spark, url, "skewed", key=key, parts=8, driver=driver)
        sizes = sorted(r[1] for r in parts.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        assert sorted(map(str, map(tuple, parts.collect()))) == sorted(map(str, map(tuple, rows.collect())))
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", driver=driver).save()
    assert tables.database_by_quantiles(spark, url, "nothing", key="k", driver=driver).count() == 0
    assert tables.database_by_quantiles(spark, url, "skewed", key="k", parts=1, driver=driver).count() == 5000


# ---------------------------------------------------------------- the outbox


def deliveries(spark, n, bad=False):
    i = F.col("id").cast("string")
    payload = F.concat(F.lit("text\n"), i)
    rows = spark.range(0, n, 1, 3).select(outbox.delivery_id(i, F.lit("u"), payload).alias("delivery_id"), F.lit("u").alias("url"), payload.alias("payload"))
    return rows.withColumn("payload", F.when(i == str(n - 1), F.raise_error(F.lit("broken"))).otherwise(F.col("payload")).cast("string")) if bad else rows


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names)


def test_outbox_batches(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    path = str(tmp_path / "out")
    read = lambda: spark.read.format("outbox").option("path", path).load()
    assert read().count() == 0
    deliveries(spark, 10).write.format("outbox").option("path", path).mode("append").save()
    assert read().count() == 10 and {r["payload"] for r in read().collect()} == {f"text\n{i}" for i in range(10)}
    again = outbox.undelivered(deliveries(spark, 12).unionByName(deliveries(spark, 12)), read())
    again.write.format("outbox").option("path", path).mode("append").save()
    assert read().count() == 12 and read().select("delivery_id").distinct().count() == 12


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    path = str(tmp_path / "out")
    deliveries(spark, 4).write.format("outbox").option("path", path).mode("append").save()
    before = files(path)
    with pytest.raises(Exception, match="broken"):
        deliveries(spark, 9, bad=True).write.format("outbox").option("path", path).mode("append").save()
    assert files(path) == before
    one, two = outbox.StreamWriter(path), outbox.StreamWriter(path)
    rows = [{"delivery_id": "d", "url": None, "payload": "p"}]
    one.commit([one.write(iter(rows))], 7)
    held = files(path)
    two.commit([two.write(iter(rows))], 7)  # the batch that was run again
    assert files(path) == held and list(outbox.manifests(path)) == [0, 7]


def test_outbox_as_a_stream_over_restarts(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    source, target = str(tmp_path / "a"), str(tmp_path / "b")

    def run():
        stream = spark.readStream.format("outbox").option("path", source).load()
        query = stream.writeStream.format("outbox").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()

    for n in (5, 8):
        seen = spark.read.format("outbox").option("path", source).load()
        outbox.undelivered(deliveries(spark, n), seen).write.format("outbox").option("path", source).mode("append").save()
        run()
        run()
    got = [r["delivery_id"] for r in spark.read.format("outbox").option("path", target).load().collect()]
    assert len(got) == 8 == len(set(got))


def test_deliveries_are_posted(spark):
    """To a server of this test: what arrives, with its id; refused and unreachable ones come out as such."""
    import http.server
    import json
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Idempotency-Key"], body["content"]))
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = spark.createDataFrame([("a", f"{base}/ok", "text é\n"), ("b", f"{base}/no", "x"), ("c", "http://127.0.0.1:1/", "y"), ("d", "nonsense", "z")], outbox.SCHEMA)
        got = {r["delivery_id"]: (r["error"], r["transient"]) for r in outbox.deliver(rows, outbox.post).collect()}
    finally:
        server.shutdown()
    assert got["a"] == (None, False) and sorted(seen) == [("a", "text é\n"), ("b", "x")]
    assert "404" in got["b"][0] and not got["b"][1] and got["c"][1] and not got["d"][1] and got["d"][0].startswith("ValueError")


# ---------------------------------------------------------------- requests and ends


def test_requests_meet_their_ends(spark, tmp_path):
    """A stream-stream outer join gives the rows of the batch join; what is over has left the state."""
    start, rng = datetime(2024, 1, 1, tzinfo=timezone.utc), random.Random(8)
    asked = [(i, start + timedelta(seconds=20 * i)) for i in range(60)]
    ended = [(i, t + timedelta(seconds=rng.choice([5, 100, 299, 301, 900])), rng.choice(["completed", "failed"])) for i, t in asked if i % 3]
    r_schema, f_schema = "request_id long, ts timestamp", "request_id long, ts timestamp, status string"
    want = jobs.finished_requests(spark.createDataFrame(asked, r_schema), spark.createDataFrame(ended, f_schema), within="5 minutes")

    def arrive(requests, finished):
        spark.createDataFrame(requests, r_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        spark.createDataFrame(finished, f_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))

    def run():
        r, f = (spark.readStream.schema(s).parquet(str(tmp_path / p)) for s, p in ((r_schema, "r"), (f_schema, "f")))
        query = jobs.finished_requests(r, f, within="5 minutes", lateness="1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return query.lastProgress

    late = start + timedelta(days=1)
    for a, b in ((0, 600), (600, 5000)):
        inside = lambda rows: [x for x in rows if a <= (x[1] - start).total_seconds() < b]
        arrive(inside(asked), inside(ended))
        run()
    arrive([(1000, late)], [(1000, late, "completed")])
    run()
    arrive([(1001, late + timedelta(hours=1))], [(1001, late + timedelta(hours=1), "failed")])
    progress = run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["request_id"] < 1000]
    assert sorted(got, key=str) == sorted(map(tuple, want.collect()), key=str)
    assert any(r[3] is None for r in got) and progress["stateOperators"][0]["numRowsTotal"] <= 4


def test_codes_by_language_at_a_larger_scale(spark):
    """On sf0.1 the stored sketches are still within their errors of the exact numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", reports.cache_key(F.col("text"), F.lit("p")).alias("code"), "n_chars")
    exact = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count_distinct("code").alias("n")).collect()}
    for r in sketches.estimates(sketches.sketched(docs, "lang", code="code", size="n_chars"), "lang").collect():
        assert abs(r["n_codes"] - exact[r["lang"]]) <= max(0, 4 * sketches.THETA_ERROR * exact[r["lang"]])
        assert abs(r["n_codes_hll"] - exact[r["lang"]]) <= max(1, 4 * sketches.HLL_ERROR * exact[r["lang"]])
