"""The as-of join against a plain sequence, with hot keys cut into pieces."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from quarryline.operators import asof


def rows_and_events(seed):
    """Half of all rows and events have one key; some times tie, some keys and times are null."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c", None])
    time = lambda: None if rng.random() < 0.02 else rng.randrange(400)
    rows = [(i, key(), time(), f"r{i}") for i in range(600)]
    events = [(key(), time(), rng.randrange(50), rng.choice(["x", None])) for _ in range(300)]
    return rows, events


def plain(rows, events):
    best = {}
    for k, t, v, w in events:
        if k is not None and t is not None:
            best[k, t] = max(best.get((k, t), (v, w)), (v, w), key=lambda x: (x[0], x[1] is not None))
    times = {k: sorted(t for k2, t in best if k2 == k) for k, _ in best}
    out = []
    for i, k, t, name in rows:
        before = bisect_right(times.get(k, []), t) if k is not None and t is not None else 0
        out.append((i, k, t, name, *(best[k, times[k][before - 1]] if before else (None, None))))
    return out


@pytest.mark.parametrize("hot_rows,pieces", [(1_000_000, 256), (100, 16), (0, 4), (50, 25)])
def test_as_of_against_a_sequence(spark, hot_rows, pieces):
    rows, events = rows_and_events(pieces)
    left = spark.createDataFrame(rows, "id int, k string, at int, piece string").repartition(3)
    right = spark.createDataFrame(events, "k string, at int, v int, w string").repartition(2)
    got = asof.as_of(left, right, by=("k",), at="at", carried=("v", "w"), hot_rows=hot_rows, pieces=pieces)
    assert got.columns == ["id", "k", "at", "piece", "v", "w"]
    assert sorted(map(tuple, got.collect())) == plain(rows, events)


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 5, 7)], "k string, at int, v int")
    join = lambda x, y: [tuple(r) for r in asof.as_of(x, y, by=("k",), at="at", carried=("v",), hot_rows=0, pieces=4).collect()]
    assert join(left, right) == [(1, "a", 5, 7)] and join(left, right.limit(0)) == [(1, "a", 5, None)] and join(left.limit(0), right) == []


def test_a_hot_key_goes_to_many_tasks(spark):
    """Of 8,000 rows of one key no task of the window has more than a share."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(8000).select("id", F.lit("k").alias("k"), F.col("id").alias("at"))
        right = spark.range(0, 8000, 100).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
        found = asof.as_of(left, right, by=("k",), at="at", carried=("v",), hot_rows=1000, pieces=64)
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.where("v = id - id % 100").count() == 8000 and len(sizes) > 16 and max(sizes) < 8000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
