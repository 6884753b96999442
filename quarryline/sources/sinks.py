"""Sinks: appended rows, delivered webhooks, retried deliveries with a dead-letter table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.reports import webhook_payload

#: How often, and how many seconds later, a delivery is tried again.
RETRIES, RETRY_SECONDS = 3, 60


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own, so a batch that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def webhook_rows(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """url and payload for each finished job whose user has a webhook; delivery is the caller's."""
    return jobs.join(users.where("webhook_url IS NOT NULL").select("email", "webhook_url"), "email").select(F.col("webhook_url").alias("url"), webhook_payload(F.col("report_text")).alias("payload"))


def retried(attempts: DataFrame, retries: int = RETRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, to try again, dead letters) of rows with attempt, error and transient: transient errors are retried, others never."""
    failed = F.col("error").isNotNull()
    again = failed & F.col("transient") & (F.col("attempt") < retries)
    return attempts.where(~failed), attempts.where(again).withColumn("attempt", F.col("attempt") + 1), attempts.where(failed & ~again)


def due(attempts: DataFrame, failed_at: str, seconds: int = RETRY_SECONDS) -> DataFrame:
    """Adds not_before: the time of the failure and the fixed delay."""
    return attempts.withColumn("not_before", F.col(failed_at) + F.make_dt_interval(secs=F.lit(seconds)))
