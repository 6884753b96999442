"""The plumbing around language-model replies. The model itself is a function that the caller gives.

A responder turns a DataFrame with prompt columns into one with ``reply`` and
``error``. ``stub`` is a deterministic stand-in for tests and queries; it is no
model and its replies mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.reports import is_rate_limit, stripped

Responder = Callable[[DataFrame], DataFrame]

# Statuses that rows carry.
HEALED, PENDING, RATE_LIMITED = "Auto-Healed", "Pending", "Rate Limit Exceeded - Pending"
# What explains a patch, or a hotspot without one, for each status; and where no model is online.
EXPLANATIONS = {HEALED: "AI Patch successfully generated.", RATE_LIMITED: "Groq API Rate Limit Exceeded.", PENDING: "LLM Generation failed due to an API error."}
OFFLINE = "LLM Engine is offline. Missing API Key."
ENTERPRISE_RATE_LIMITED, ERROR = "Rate Limit Exceeded", "Error"
ENTERPRISE_FILE, ENTERPRISE_RISK = "Enterprise_API_Payload", "Critical"


def stub(column: str = "code_snippet") -> Responder:
    """A stand-in: the snippet's hash as the reply, an error where the snippet asks for one."""
    reply = F.when(F.col(column).contains("raise-429"), F.lit(None)).when(F.col(column).contains("raise-error"), F.lit(None)).otherwise(F.concat(F.lit(" fixed "), F.md5(column), F.lit("\n")))
    error = F.when(F.col(column).contains("raise-429"), "HTTP 429").when(F.col(column).contains("raise-error"), "connection reset")
    return lambda df: df.withColumns({"reply": reply, "error": error})


def first_reply(*replies: Column) -> Column:
    """The first provider's reply that is not null; null if all failed."""
    return F.coalesce(*replies)


def hotspot_status(online: Column | None = None) -> Column:
    """The status of a hotspot's row from ``reply`` and ``error``; an empty reply heals too."""
    base = F.when(F.col("error").isNull(), HEALED).when(is_rate_limit(F.col("error")), RATE_LIMITED).otherwise(PENDING)
    return base if online is None else F.when(online, base).otherwise(PENDING)


def explanation(status: Column, online: Column | None = None) -> Column:
    """The sentence that goes with a hotspot's status."""
    text = F.element_at(F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair]), status)
    return text if online is None else F.when(online, text).otherwise(F.lit(OFFLINE))


def heal(found: DataFrame, responder: Responder, *keys: str, file_name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(scan rows, patches): one row for each hotspot, one patch with its explanation for each that got a reply with text in it."""
    answered = responder(found).withColumns({"suggested_code": stripped(F.col("reply")), "status": hotspot_status()})
    scans = answered.select(*keys, F.col(file_name).alias("fileName"), F.col("node_type").alias("vulnerabilityType"), F.col("risk_level").alias("riskLevel"), "status")
    patches = answered.where(F.col("suggested_code") != "").select(*keys, F.col("pos").alias("hotspot_index"), F.col("code_snippet").alias("original_code"), "suggested_code", explanation(F.col("status")).alias("explanation"))
    return scans, patches


def file_counts(found: DataFrame, patches: DataFrame, *keys: str) -> DataFrame:
    """keys, n_hotspots, n_patches of each file with a hotspot; both are counted before they are joined."""
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return counted(found, "n_hotspots").join(counted(patches, "n_patches"), list(keys), "left").fillna(0, ["n_patches"])


def enterprise(requests: DataFrame, responder: Responder, online: bool = True) -> tuple[DataFrame, DataFrame]:
    """(responses, scan rows). requests: request_id, code_snippet, vulnerability_type, zero_retention.

    No row is kept where retention is off, nor where the engine is offline.
    """
    typed = requests.withColumns({"vulnerability_type": F.coalesce("vulnerability_type", F.lit("Unknown Vulnerability")), "zero_retention": F.coalesce("zero_retention", F.lit(False))})
    if not online:
        return typed.select("request_id", F.col("code_snippet").alias("original_code"), F.lit(None).cast("string").alias("fixed_code"), F.lit(ERROR).alias("status")), typed.where("false").select("request_id")
    status = F.when(F.col("error").isNull(), HEALED).when(is_rate_limit(F.col("error")), ENTERPRISE_RATE_LIMITED).otherwise(ERROR)
    answered = responder(typed).withColumn("status", status)
    rows = answered.where(~F.col("zero_retention")).select("request_id", F.lit(ENTERPRISE_FILE).alias("fileName"), F.col("vulnerability_type").alias("vulnerabilityType"), F.lit(ENTERPRISE_RISK).alias("riskLevel"), "status")
    return answered.select("request_id", F.col("code_snippet").alias("original_code"), stripped(F.col("reply")).alias("fixed_code"), "status"), rows
