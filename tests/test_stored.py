"""Stored tables and the stored index: what changes, what stays, what is read."""

import os
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quarryline.operators import file_index, retrieval
from quarryline.sources import stored

DOCS, ITEMS = ("/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.001/benchmark.parquet")


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, seq long, status string, report string, n int")


def jobs(path, buckets=8):
    return stored.Stored(path, ("id",), (("status", "string"), ("report", "string"), ("n", "int")), buckets)


def plain(batches):
    state = {}
    for k, seq, *values in [r for b in batches for r in b]:
        row = state.setdefault(k, [None] * 3)
        for i, v in enumerate(values):
            if v is not None and (row[i] is None or (seq, v) > row[i]):
                row[i] = seq, v
    return sorted((k, *[None if v is None else v[1] for v in row]) for k, row in state.items())


def test_any_order_of_batches_and_repeats_give_one_table(spark, tmp_path):
    rng = random.Random(1)
    some = lambda *x: rng.choice([None, *x])
    batches = [[(rng.randrange(20), rng.randrange(100), some("pending", "completed", "failed"), some("r1", "r2"), some(1, 2)) for _ in range(30)] for _ in range(3)]
    want = plain(batches)
    for n, order in enumerate(permutations(range(3))):
        table = jobs(str(tmp_path / str(n)))
        for i in (*order, order[0]):  # the first batch once more, now late
            table.apply(changes(spark, batches[i]), "seq")
        assert sorted(map(tuple, table.read(spark).collect())) == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = jobs(str(tmp_path / "t"))
    assert table.apply(changes(spark, [(i, 1, "pending", None, i) for i in range(100)]), "seq") == list(range(8))
    before, one = files_of(tmp_path / "t"), changes(spark, [(5, 2, "completed", "text", None)])
    touched = table.apply(one, "seq")
    kept = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert len(touched) == 1 and kept <= files_of(tmp_path / "t") and not (before - kept) & files_of(tmp_path / "t")
    assert table.read(spark).where("id = 5").first() == (5, "completed", "text", 5) and table.read(spark).count() == 100
    assert table.apply(changes(spark, []), "seq") == [] and table.read(spark).count() == 100


def test_keys_may_be_null_or_several(spark, tmp_path):
    table = stored.Stored(str(tmp_path / "t"), ("a", "b"), (("v", "string"),), 4)
    rows = [(None, 1, 1, "x"), (None, 1, 2, "y"), ("k", None, 1, "z"), ("k", 2, 1, None)]
    for _ in range(2):
        table.apply(spark.createDataFrame(rows, "a string, b int, seq long, v string"), "seq")
    assert sorted(map(str, map(tuple, table.read(spark).collect()))) == ["('k', 2, None)", "('k', None, 'z')", "(None, 1, 'y')"]


# ---------------------------------------------------------------- the index


def versions(spark, text, version):
    return spark.read.parquet(DOCS).select(F.lit("r").alias("repo_id"), F.col("doc_id").cast("string").alias("file_id"), text.alias("content"), F.lit(version).alias("version"), F.col("doc_id").alias("place"))


def wanted(spark, k, files):
    asked = retrieval.query_counts(spark.read.parquet(ITEMS), "item_id", "text")
    best = retrieval.top_k(retrieval.scores(retrieval.occurrences(files, "file_id", "place"), asked, "item_id", "file_id", "place"), "item_id", "place", k)
    return sorted(map(tuple, best.select("item_id", "rank", "file_id", "score").collect()))


def found(index, spark, k, repo=None):
    asked = retrieval.query_counts(spark.read.parquet(ITEMS), "item_id", "text").withColumnRenamed("item_id", "key")
    return sorted(map(tuple, index.search(asked, k, repo).select("key", "rank", "file_id", "score").collect()))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    index = file_index.FileIndex(str(tmp_path_factory.mktemp("index") / "i"), buckets=4, block_files=8)
    index.ingest(versions(spark, F.col("text"), 0).unionByName(versions(spark, F.col("text"), 0)))  # every row twice
    return index


@pytest.mark.parametrize("k", [1, 3, 500])
def test_search_equals_a_scan(spark, index, k):
    assert found(index, spark, k) == wanted(spark, k, versions(spark, F.col("text"), 0)) != []


def test_blocks_out_of_reach_are_not_read(spark, index):
    asked = retrieval.query_counts(spark.read.parquet(ITEMS), "item_id", "text").withColumnRenamed("item_id", "key")
    every = index.bounds(asked).count()
    _, rest = index.open_blocks(asked, 1)
    assert rest.count() + asked.select("key").distinct().count() < every / 2
    plan = index.bounds(asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "entries" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1].split("\n")[0]


def test_first_scores_and_open_blocks_are_computed_once(spark, index):
    """They are read from what was written: no use of them reads the postings or joins again."""
    asked = retrieval.query_counts(spark.read.parquet(ITEMS), "item_id", "text").withColumnRenamed("item_id", "key")
    for part in index.open_blocks(asked, 1):
        assert not any(x in part._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Window", "Aggregate"))


def test_files_are_ingested_again(spark, tmp_path):
    """Longer, shorter and empty texts take the place of the old ones; a repository of its own; compaction changes nothing."""
    index = file_index.FileIndex(str(tmp_path / "i"), buckets=4, block_files=16)
    index.ingest(versions(spark, F.col("text"), 0))
    i = F.col("place")
    text = F.when(i % 6 == 0, F.concat_ws(" ", "content", "content")).when(i % 6 == 2, F.substring("content", 1, 60)).when(i % 6 == 4, F.lit("")).otherwise(F.col("content"))
    new = versions(spark, F.col("text"), 1).withColumn("content", text)
    index.ingest(new.where("place % 2 = 0").withColumn("place", F.col("place") + 1000))  # the first place stays
    want = wanted(spark, 3, new)
    assert found(index, spark, 3) == want
    index.ingest(new.withColumn("repo_id", F.lit("other")))
    assert found(index, spark, 3, "r") == want
    before = index.postings(spark).select(F.explode("entries")).count()
    index.compact(spark)
    assert found(index, spark, 3, "r") == want and index.postings(spark).select(F.explode("entries")).count() < before
    assert index._segments(spark) == [3]


def test_an_old_version_does_not_come_back(spark, tmp_path):
    index = file_index.FileIndex(str(tmp_path / "i"), buckets=2)
    one = lambda text, version: spark.createDataFrame([("r", "f", text, version, 0)], "repo_id string, file_id string, content string, version long, place long")
    for text, version in (("alpha beta", 1), ("gamma", 3), ("alpha alpha", 2)):
        index.ingest(one(text, version))
    asked = spark.createDataFrame([(1, "alpha", 1), (2, "gamma", 2)], "key int, token string, qn long")
    assert [tuple(r) for r in index.search(asked, 5).collect()] == [(2, 1, "r", "f", 2.0)]


def shuffled(spark, run):
    """Records that ``run`` shuffles."""
    context = spark.sparkContext
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None))
    before = max((s.stageId() for s in stages()), default=-1)
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > before)


def test_entries_are_not_shuffled_to_write_them(spark, tmp_path):
    """Some rows for each file, not one for each of its tokens; a token's entries are in blocks of the size that is asked."""
    index = file_index.FileIndex(str(tmp_path / "i"), buckets=4, block_files=8)
    files = versions(spark, F.col("text"), 0)
    n = shuffled(spark, lambda: index.ingest(files))
    entries = index.postings(spark).select(F.explode("entries"))
    assert n < 12 * files.count() < entries.count() / 4
    assert entries.count() == retrieval.term_counts(files, "file_id").count()


def test_a_version_that_is_ingested_again_counts_once(spark, tmp_path):
    index = file_index.FileIndex(str(tmp_path / "i"), buckets=2)
    one = spark.createDataFrame([("r", "f", "alpha beta", 1, 0)], "repo_id string, file_id string, content string, version long, place long")
    for _ in range(2):
        index.ingest(one)
    asked = spark.createDataFrame([(1, "alpha", 1)], "key int, token string, qn long")
    assert [tuple(r) for r in index.search(asked, 5).collect()] == [(1, 1, "r", "f", 0.5)]
    index.compact(spark)
    assert [tuple(r) for r in index.search(asked, 5).collect()] == [(1, 1, "r", "f", 0.5)]


def test_long_files_have_blocks_of_their_own(spark, tmp_path, monkeypatch):
    """Blocks are bounded by their tokens too; odd letters and nulls; nothing at all."""
    monkeypatch.setattr(file_index, "BLOCK_TOKENS", 4)
    index = file_index.FileIndex(str(tmp_path / "i"), buckets=2)
    schema = "repo_id string, file_id string, content string, version long, place long"
    texts = ["ΟΔΟΣ ΟΔΟΣ İstanbul", "straße STRASSE ǅungla", None, "", "a b", "οδος xyz xyz"] + ["xyz abc def"] * 20
    files = spark.createDataFrame([("r", str(i), t, 1, i) for i, t in enumerate(texts)], schema)
    index.ingest(files)
    assert index.blocks(spark).select("block").distinct().count() > 5 and index.blocks(spark).count() == 23
    asked = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["οδος", "xyz", "strasse", "straße", "none"])], "key int, token string, qn long")
    best = retrieval.top_k(retrieval.scores(retrieval.occurrences(files, "file_id", "place"), asked, "key", "file_id", "place"), "key", "place", 4)
    want = sorted(map(tuple, best.select("key", "rank", "file_id", "score").collect()))
    assert sorted(map(tuple, index.search(asked, 4).select("key", "rank", "file_id", "score").collect())) == want != []
    nothing = file_index.FileIndex(str(tmp_path / "n"), buckets=2)
    nothing.ingest(files.where("place = 3"))
    assert nothing.search(asked, 4).count() == 0
