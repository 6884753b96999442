"""Mapping of findings to regulations, scores and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.reports import readiness
from quarryline.names import fresh

STARTING_SCORE = 100
DEFAULT = "default_vulnerability"
NO_DESCRIPTION = "No description provided."

# Finding type, SOC 2, GDPR, ISO 27001, penalty.
DIMENSION = [
    ("hardcoded_secret", "CC6.1 (Logical Access Security)", "Article 32(1)(a) (Pseudonymisation and Encryption)", "A.9.4.3 (Password Management System)", 25),
    ("sql_injection", "CC6.6 (Protection against Malicious Software/Attacks)", "Article 32(1)(b) (Confidentiality, Integrity, Availability)", "A.14.2.1 (Secure Development Policy)", 30),
    ("xss", "CC6.6 (Protection against Malicious Software/Attacks)", "Article 32(1)(b) (Integrity of Processing Systems)", "A.14.2.5 (Secure System Engineering Principles)", 20),
    ("default_vulnerability", "CC7.1 (System Operations and Monitoring)", "Article 32(1)(d) (Regular Testing/Evaluating)", "A.12.6.1 (Management of Technical Vulnerabilities)", 10),
]


def dimension(spark: SparkSession) -> DataFrame:
    """The four rows of the mapping."""
    return spark.createDataFrame(DIMENSION, "mapped STRING, soc2 STRING, gdpr STRING, iso27001 STRING, penalty_weight INT")


def items(scans: DataFrame, key: str = "scan_id", column: str = "items") -> DataFrame:
    """key, pos, vulnerability_type, description from a column of JSON text.

    Only arrays count; of their items only objects; a missing type is
    ``unknown``, one that is no text drops the item; a missing description has
    a default and an explicit null stays null.
    """
    # variant_explode takes objects apart too, so what is no array becomes an empty one first
    parsed = scans.select(key, F.try_parse_json(F.col(column)).alias("v")).withColumn("v", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")))
    each = parsed.lateralJoin(scans.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key, "pos", F.col("value").alias("item"))
    item, kind = F.col("item"), F.schema_of_variant(F.col("item"))
    type_kind = F.schema_of_variant(F.try_variant_get(item, "$.type", "variant"))
    described = F.try_variant_get(item, "$.description", "variant")
    return each.where(kind.startswith("OBJECT") & (type_kind.isNull() | (type_kind == "STRING"))).select(
        key,
        "pos",
        F.when(type_kind.isNull(), F.lit("unknown")).otherwise(F.lower(F.try_variant_get(item, "$.type", "string"))).alias("vulnerability_type"),
        F.when(described.isNull(), F.lit(NO_DESCRIPTION)).otherwise(F.try_variant_get(item, "$.description", "string")).alias("description"),
    )


def violations(found: DataFrame) -> DataFrame:
    """Adds soc2, gdpr, iso27001 and score_penalty to rows with vulnerability_type; unmapped types get the default row."""
    dim = F.broadcast(dimension(found.sparkSession))  # four rows
    target = F.when(F.lower("vulnerability_type").isin(*[row[0] for row in DIMENSION]), F.lower("vulnerability_type")).otherwise(DEFAULT)
    return found.withColumn("mapped", target).join(dim, "mapped").withColumnRenamed("penalty_weight", "score_penalty").drop("mapped")


def scores(scans: DataFrame, found: DataFrame, key: str = "scan_id", starting_score: int = STARTING_SCORE) -> DataFrame:
    """key, score, status, processed for every scan, those without findings too."""
    penalties, number = fresh("penalties", scans.select(key)), fresh("number", scans.select(key))
    sums = violations(found).groupBy(key).agg(F.sum("score_penalty").alias(penalties), F.count("*").alias(number))
    score = F.greatest(F.lit(0).cast("long"), F.lit(starting_score) - F.coalesce(penalties, F.lit(0)))
    return scans.select(key).join(sums, key, "left").select(key, score.alias("score"), readiness(score).alias("status"), F.coalesce(number, F.lit(0)).alias("processed"))


def reports(scans: DataFrame, found: DataFrame, key: str = "scan_id", starting_score: int = STARTING_SCORE) -> DataFrame:
    """One nested report for each scan, its violations in their order; a scan's list is one cell of the result."""
    impact = F.struct(F.col("soc2").alias("SOC_2"), F.col("gdpr").alias("GDPR"), F.col("iso27001").alias("ISO_27001"))
    violation = F.struct("pos", "vulnerability_type", "description", impact.alias("regulatory_impact"), "score_penalty")
    lists = violations(found).groupBy(key).agg(F.array_sort(F.collect_list(violation)).alias("compliance_violations"))
    return scores(scans, found, key, starting_score).join(lists, key, "left")
