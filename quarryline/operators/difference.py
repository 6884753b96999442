"""The difference of two tables as multisets, with counts.

Rows go to buckets by their hash, and each bucket has a digest: how many rows,
and two sums of their hashes. Only buckets whose digests differ are compared row
by row; where two ingests are nearly equal, that is next to nothing, and the rows
of equal buckets are never shuffled. Two buckets with different rows have equal
digests with a chance of some 2 ** -100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.names import fresh

BUCKETS = 4096


def _bucketed(df: DataFrame, columns: list[str], h: str, bucket: str, buckets: int) -> DataFrame:
    return df.select(*columns).withColumn(h, F.xxhash64(*columns)).withColumn(bucket, F.pmod(F.col(h), F.lit(buckets)))


def open_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket: those that do not have the same rows on both sides."""
    columns = left.columns

    def digests(df: DataFrame, side: str) -> DataFrame:
        total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
        return _bucketed(df, columns, "__h", "bucket", buckets).groupBy("bucket").agg(F.struct(F.count("*"), total("__h"), total(F.lit(7), *columns)).alias(side))

    return digests(left, "l").join(digests(right, "r"), "bucket", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")


def difference(left: DataFrame, right: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """The columns and n: by how many rows ``left`` has more (n > 0) or fewer of the same; nulls equal each other."""
    columns, n = left.columns, fresh("n", left)
    h, bucket = fresh("h", left), fresh("bucket", left)
    differ = F.broadcast(open_buckets(left, right, buckets).withColumnRenamed("bucket", bucket))  # ``buckets`` numbers at most
    counted = lambda df, one: _bucketed(df, columns, h, bucket, buckets).join(differ, bucket, "left_semi").select(*columns, F.lit(one).cast("long").alias(n))
    return counted(left, 1).unionByName(counted(right, -1)).groupBy(*columns).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
