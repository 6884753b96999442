"""The mixture: clashing names, equal rows at the cut, and refined ranges."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarryline.llm import mixing

SF = "/root/testdata/sf0.001"
NAMES = ("key", "h", "place", "size", "row", "copies", "last", "ties", "whole", "need", "range", "rows", "sum", "part", "n", "left", "before", "extra", "col", "target", "source_size", "id", "__key", "__h", "__mix_key", "__mix_copy", "__mix_times", "__id", "__text")


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    plain, named = mixing.mix(docs), mixing.mix(clash)
    assert named.columns == clash.columns
    got = named.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in plain.collect())
    assert all(r[n] == f"own {n}" for r in got for n in NAMES)
    assert Counter(r["doc_id"] for r in got) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_plan(clash).collect() if r["copies"]})


def repeated(spark, rows=900):
    """A source that is one row many times over, and another of rows that differ."""
    same = spark.range(rows).select(F.lit(7).cast("long").alias("doc_id"), F.lit("five words of one text").alias("text"), F.lit("a").alias("source"))
    other = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 9).cast("int"))).alias("text"), F.lit("b").alias("source"))
    return same.union(other).repartition(6)


@pytest.mark.parametrize("operator", ["plan", "mix"])
def test_equal_rows_at_the_cut(spark, operator, tmp_path):
    repeated(spark).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    target = {("a" if r["doc_id"] == 7 else "b"): r["target"] for r in rows}
    if operator == "plan":
        taken = Counter()
        for r in rows:
            taken["a" if r["doc_id"] == 7 else "b"] += r["taken"]
        assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix_plan(docs.repartition(3)).collect())
    else:
        taken = Counter()
        for r in mixing.mix(docs).collect():
            taken[r["source"]] += len(r["text"].split())
    assert abs(taken["a"] - target["a"]) <= 5 and abs(taken["b"] - target["b"]) <= 9, (taken, target)


def test_refined_ranges(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "SORTED_ROWS", 0)
    monkeypatch.setattr(mixing, "RANGE_BITS", 3)
    assert sorted(map(tuple, mixing.mix_plan(docs).collect())) == want


def test_targets_of_awkward_sources(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 0), ("sc", 100000), ("n", 3)], "key string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights by name, null last: a 5, b 2, c 1, null 5; a, b and null are full, c takes the rest
    assert got == {"sa": 30.0, "sb": 0.0, "sc": 100013.0 - 39.0, "n": 9.0}


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_plan(docs).collect()} == {(None, 0, 0), (1, 0, 0)}
    assert pq.read_table(f"{SF}/documents.parquet").num_rows and mixing.mix(docs.where("doc_id = 5")).count() == 0
