"""Tables: Parquet, CSV, JSON or a database, with a schema given and nothing inferred."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.reports import NO_NAME
from quarryline.schemas import SCAN_REQUEST, TABLES

T = TypeVar("T")
#: How often a connection is tried, and the seconds between.
ATTEMPTS, ATTEMPT_SECONDS = 5, 5.0
#: Connections at once, as many as a pool with overflow gives.
CONNECTIONS = 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """One of the engine's own tables (``schemas.TABLES``) from a folder of files of any kind that Spark reads."""
    return spark.read.schema(TABLES[name]).format(kind).load(f"{folder.rstrip('/')}/{name}")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def connected(connect: Callable[[], T], *, transient: tuple[type[Exception], ...] = (OSError,), attempts: int = ATTEMPTS, seconds: float = ATTEMPT_SECONDS, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``connect`` returns, tried again after a fixed delay while it raises a transient error; the last error is raised, and any other at once."""
    for attempt in range(1, attempts + 1):
        try:
            return connect()
        except transient:
            if attempt == attempts:
                raise
            sleep(seconds)
    raise ValueError("attempts must be 1 or more")


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Code payloads as JSON lines, one request each."""
    return json(spark, path, SCAN_REQUEST)


def database(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int = 0, high: int = 0, **options: str) -> DataFrame:
    """A table over JDBC, read by ranges of ``key`` with CONNECTIONS connections at most. The driver's jar must be on the class path.

    Its schema is read at once, so an unreachable server is an error here; ``connected`` tries again.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(CONNECTIONS))
    return reader.load()


def database_by_quantiles(spark: SparkSession, url: str, name: str, *, key: str, parts: int = CONNECTIONS, **options: str) -> DataFrame:
    """A table over JDBC in ``parts`` reads of about equally many rows: cut at quantiles of ``key`` (numbers, text, dates or times), which is read before, alone.

    No two reads overlap, and the rows without a key go with the first. Rows of
    one key stay together, so a key of very many rows is a read of its own.
    """
    keys = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select(key).where(F.col(key).isNotNull())
    numeric = keys.schema[key].dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    if numeric or keys.schema[key].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz"):
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = keys.agg(F.percentile_approx(key, shares, F.lit(1000 * parts))).first()[0] if parts > 1 else None
    else:  # text has no percentiles: by the keys of a sample that is bounded by its rate
        sample = sorted(r[0] for r in keys.sample(min(1.0, 1000.0 * parts / max(keys.count(), 1)), seed=1).collect())
        found = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else None
    cuts = sorted(set(found or ()))
    text = lambda v: str(v) if numeric else "'" + str(v).replace("'", "''") + "'"
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    below, from_ = [f"{column} <= {text(v)}" for v in cuts], [f"{column} > {text(v)}" for v in cuts]
    predicates = [" AND ".join(x) for x in zip(["1 = 1", *from_], [*below, "1 = 1"])]
    predicates[0] = f"({predicates[0]}) OR {column} IS NULL" if cuts else "1 = 1"
    return spark.read.jdbc(url, name, predicates=predicates, properties=options)


def code_files(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Whole text files as repo_id, filename, content, seq: the order of ingestion, which is that of modification, then of the name."""
    seq = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
    return spark.read.text(path, wholetext=True).select(F.lit(repo_id).alias("repo_id"), F.col("_metadata.file_path").alias("filename"), F.col("value").alias("content"), seq.alias("seq"))


def ingest_requests(requests: DataFrame) -> DataFrame:
    """repo_id, filename, content, seq from rows of (request_id, repo_id, files: array of maps); defaults stand where a key is missing, not where it is null."""
    each = requests.select("request_id", "repo_id", F.posexplode("files").alias("pos", "f"))
    get = lambda key, default: F.when(F.map_contains_key("f", F.lit(key)), F.try_element_at("f", F.lit(key))).otherwise(F.lit(default)).alias(key)
    return each.select("repo_id", get("filename", NO_NAME), get("content", ""), F.struct("request_id", "pos").alias("seq"))


def saved_files(events: DataFrame) -> DataFrame:
    """Editor saves that are scanned: JavaScript and TypeScript."""
    return events.where(F.col("language").isin("javascript", "typescript"))


def scan_commands(events: DataFrame) -> DataFrame:
    """Editor commands with any code, by the file's base name."""
    from quarryline.functions.reports import basename, is_blank

    return events.where(~is_blank(F.col("code"))).withColumn("filename", basename(F.col("path")))
