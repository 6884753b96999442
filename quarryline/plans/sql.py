"""The engine's tables and operators for SQL text: views, scalar and table functions, recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import redaction, reports
from quarryline.operators import compliance
from quarryline.sources.tables import table

#: Functions in SQL text; a table function is used with LATERAL.
FUNCTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION penalty_status(score BIGINT) RETURNS STRING
  RETURN CASE WHEN score < 50 THEN 'CRITICAL FAIL (AUDIT BLOCKED)' WHEN score < 80 THEN 'AT RISK (REMEDIATION REQUIRED)' ELSE 'READY' END;
CREATE OR REPLACE TEMPORARY FUNCTION invited_by(inviter BIGINT) RETURNS TABLE (user_id BIGINT, org_id INT)
  RETURN SELECT u.user_id, u.org_id FROM users u WHERE u.inviter = invited_by.inviter;
CREATE OR REPLACE TEMPORARY FUNCTION members_of(org INT) RETURNS TABLE (user_id BIGINT, name STRING)
  RETURN SELECT u.user_id, u.name FROM users u WHERE u.org_id = members_of.org
"""


def register(spark: SparkSession, sf: str) -> None:
    """Views users, organizations, findings, files and the functions above in the session."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("org_id"), F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 2 END").alias("inviter"))
    users.createOrReplaceTempView("users")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name")).createOrReplaceTempView("organizations")
    found = table(spark, sf, "events").select("event_id", F.col("user_id").alias("scan_id"), F.when(F.col("event_type") == "error", "hardcoded_secret").otherwise("xss").alias("vulnerability_type"))
    compliance.violations(found).createOrReplaceTempView("findings")
    text = F.col("text")
    files = table(spark, sf, "documents").select("doc_id", redaction.redact(text).alias("content"), redaction.secrets_found(text).alias("secrets"), reports.cache_key(text, F.lit("")).alias("code_hash"))
    files.createOrReplaceTempView("files")
    for statement in FUNCTIONS.strip().split(";\n"):
        spark.sql(statement)


#: Each user with the chain of invitations that leads to them, the first inviter before all; its rows are as many as the users.
INVITATIONS = """
WITH RECURSIVE chain(user_id, depth, path) AS (
  SELECT user_id, 0, CAST(user_id AS STRING) FROM users WHERE inviter IS NULL
  UNION ALL
  SELECT u.user_id, c.depth + 1, concat(c.path, '>', CAST(u.user_id AS STRING)) FROM users u JOIN chain c ON u.inviter = c.user_id
)
SELECT c.user_id, c.depth, c.path, o.name AS org_name FROM chain c JOIN users u USING (user_id) JOIN organizations o USING (org_id)
"""
#: Organizations by what their members' findings cost, and those whom each member invited.
STANDINGS = """
SELECT o.org_id, count(*) AS n_members, sum(f.cost) AS cost, penalty_status(CAST(greatest(0, 100 - coalesce(max(f.cost), 0)) AS BIGINT)) AS worst,
       sum((SELECT count(*) FROM invited_by(m.user_id))) AS n_invited
FROM organizations o JOIN LATERAL members_of(o.org_id) m LEFT JOIN (SELECT scan_id, sum(score_penalty) AS cost FROM findings GROUP BY scan_id) f ON f.scan_id = m.user_id
GROUP BY o.org_id
"""


def invitation_chain(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(INVITATIONS)


def organization_standing(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf)
    return spark.sql(STANDINGS)


QUERIES = {f.__name__: f for f in (invitation_chain, organization_standing)}

ORACLE_SQL = {
    "invitation_chain": """WITH RECURSIVE chain AS (SELECT c_custkey AS user_id, 0 AS depth, CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey = 0
          UNION ALL SELECT u.c_custkey, depth + 1, path || '>' || u.c_custkey FROM customer u JOIN chain c ON u.c_custkey // 2 = c.user_id AND u.c_custkey > 0)
        SELECT user_id, CAST(depth AS INTEGER) AS depth, path, n_name AS org_name FROM chain JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey""",
    "organization_standing": """WITH f AS (SELECT user_id, sum(CASE event_type WHEN 'error' THEN 25 ELSE 20 END) AS cost FROM events GROUP BY 1), i AS (SELECT c_custkey // 2 AS inviter, count(*) AS n FROM customer WHERE c_custkey > 0 GROUP BY 1),
        o AS (SELECT c_nationkey AS org_id, count(*) AS n_members, CAST(sum(cost) AS BIGINT) AS cost, greatest(0, 100 - coalesce(max(cost), 0)) AS score, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_invited
          FROM customer LEFT JOIN f ON user_id = c_custkey LEFT JOIN i ON inviter = c_custkey GROUP BY 1)
        SELECT org_id, n_members, cost, CASE WHEN score < 50 THEN 'CRITICAL FAIL (AUDIT BLOCKED)' WHEN score < 80 THEN 'AT RISK (REMEDIATION REQUIRED)' ELSE 'READY' END AS worst, n_invited FROM o""",
}
