"""Structured Streaming forms. Each gives what its batch operator gives over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.schemas import EVENTS, SCAN_REQUEST
from quarryline.sources.sinks import append_once

LATENESS = "10 minutes"


def request_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Code payloads as they arrive in a folder, as JSON lines."""
    return spark.readStream.schema(SCAN_REQUEST).option("maxFilesPerTrigger", files_at_once).json(folder)


def run_jobs(requests: DataFrame, responder: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """The job runner: every request becomes a completed or failed row under ``path``, each batch once however often it is run.

    Returns the started query; a restart with the same checkpoint goes on where it stopped.
    """

    def finish(batch: DataFrame, number: int) -> None:
        answered = responder(batch)
        status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
        append_once(path)(answered.select("request_id", status.alias("status"), F.coalesce("reply", "error").alias("report_text")), number)

    return requests.writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).start()


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_at_once: int = 64) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def without_repeats(events: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Redelivered events go, as long as they come within the lateness."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def finding_windows(events: DataFrame, *keys: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Counts by event-time window; the watermark is ignored in batch."""
    marked = events.withWatermark(ts, lateness) if events.isStreaming else events
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def finding_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Counts by session: runs of a key's events with less than the gap between them."""
    marked = events.withWatermark(ts, lateness) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key as a running aggregate (update or complete mode)."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(key, "last.*")


def finished_requests(requests: DataFrame, finished: DataFrame, *, within: str, key: str = "request_id", lateness: str = LATENESS) -> DataFrame:
    """request_id, asked, ended, status: each request with the job that ended within that time after it, null where none did.

    requests: key, ts; finished: key, ts, status. As a stream, a request
    without an end comes out once its time and the lateness are over, and both
    sides' rows leave the state then.
    """
    marked = lambda df: df.withWatermark("ts", lateness) if df.isStreaming else df
    r = marked(requests).select(F.col(key).alias("request_id"), F.col("ts").alias("asked"))
    f = marked(finished).select(F.col(key).alias("of"), F.col("ts").alias("ended"), "status")
    near = (F.col("of") == F.col("request_id")) & (F.col("ended") >= F.col("asked")) & (F.col("ended") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return r.join(f, near, "left").select("request_id", "asked", "ended", "status")
