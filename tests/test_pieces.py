"""Numbers within hot keys against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import dashboard, pieces


@pytest.mark.parametrize("hot_rows,parts", [(10**6, 256), (50, 16), (0, 4)])
def test_numbers_against_a_sort(spark, hot_rows, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(40)]), i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "org string, created int, key int, piece string").repartition(3)
    got = pieces.numbered(df, by="org", at="created", ties="key", name="position", hot_rows=hot_rows, pieces=parts)
    assert got.columns == ["org", "created", "key", "piece", "position"]
    want = []
    for org in ("hot", "a", "b"):
        own = sorted((r for r in rows if r[0] == org), key=lambda r: (r[1] is None, -(r[1] or 0), -r[2]))
        want += [(*r, i) for i, r in enumerate(own, 1)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_large_vault_is_numbered_by_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        vault = spark.range(8000).select(F.lit(1).alias("org"), F.timestamp_seconds(F.col("id") % 4000).alias("created"), "id")
        found = dashboard.vault_by_org(vault, org="org", created="created", key="id", hot_rows=1000)
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 16 and max(sizes) < 8000 / 8
        assert found.select("position").distinct().count() == 8000 and found.where("position = 1").first()["id"] == 7999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
