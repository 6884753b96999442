"""A stored table with keys: rows are changed in place, bucket by bucket.

The table lies in folders, one for each bucket of the key's hash. A batch of
changes is merged with the buckets that it touches, and these alone are
written, by dynamic partition overwrite: Spark puts the new files in the place
of the old ones when all tasks are done, and what no change touches keeps its
files. Each value is kept with the number of the change that set it, and of two
changes of one value that with the larger number counts (of equal numbers the
larger value). So the table does not depend on the order in which batches
arrive or how often one is applied, and a batch that failed is applied again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def shared_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the folder that driver and executors share, ``spark.checkpoint.dir``; nothing is created yet."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the same rows for every use, whatever executors are lost."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass(frozen=True)
class Stored:
    """The table at ``path``: ``key`` columns, and ``values`` (names with types) that changes set."""

    path: str
    key: tuple[str, ...]
    values: tuple[tuple[str, str], ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def changed(self, changes: DataFrame, seq: str) -> DataFrame:
        """bucket, key and each value with its number: the last change of each value of each key, null where there is none."""
        last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).cast("long").alias("seq"), F.col(c).cast(kind).alias("value")))).alias(c) for c, kind in self.values]
        return changes.groupBy(*self.key).agg(*last).select(self.bucket().alias("bucket"), *self.key, *[c for c, _ in self.values])

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table as it is stored, of all buckets or some."""
        stored = spark.read.parquet(self.path)
        return stored if buckets is None else stored.where(F.col("bucket").isin(buckets))

    def apply(self, changes: DataFrame, seq: str) -> list[int]:
        """Merge ``changes`` (key, seq, values; a null value leaves the stored one) and return the buckets that were written."""
        spark, new = changes.sparkSession, self.changed(changes, seq)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # ``buckets`` numbers at most
        if not touched:
            return touched
        if exists(spark, self.path):
            both = self.rows(spark, touched).unionByName(new)
            new = both.groupBy("bucket", *self.key).agg(*[F.max(c).alias(c) for c, _ in self.values])
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        """key and values."""
        return self.rows(spark).select(*self.key, *[F.col(f"{c}.value").alias(c) for c, _ in self.values])
