"""Pull-request events: routing, and what is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("opened", "synchronize")


def route(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds action, pr_number, repository and routed; an absent action is not routed."""
    at = lambda path: F.get_json_object(F.col(payload), path)
    return events.withColumns({"action": at("$.action"), "pr_number": at("$.pull_request.number").cast("long"), "repository": at("$.repository.full_name")}).withColumn("routed", F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)))
