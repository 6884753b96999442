"""The query registry of the engine's own operators, with DuckDB SQL for each that SQL can express.

The given tables stand in for the engine's: documents for code files, orders
for reports, events for requests, findings and jobs, nations for
organizations, customers for users. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import redaction, reports
from quarryline.operators import compliance, dashboard, responder, retrieval, state, webhooks
from quarryline.plans import sql, workflows
from quarryline.sources.tables import table
from quarryline.streaming import jobs

PROMPT = "analyze"
TOP_K = 2
#: Which finding an event stands for.
FINDINGS = {"error": "hardcoded_secret", "signup": "SQL_Injection", "purchase": "xss", "click": "insecure_eval_call"}


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as report rows: the priority is the text (one of them empty, one null), the status says scan, fix or neither."""
    priority = F.replace(F.col("o_orderpriority"), F.lit("URGENT"), F.lit("CRITICAL"))
    text = F.when(F.col("o_orderkey") % 97 == 0, F.lit("")).when(F.col("o_orderkey") % 89 == 0, F.lit(None)).otherwise(priority)
    is_fix = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("report_text"), is_fix.alias("is_fix"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in FINDINGS.items() for x in pair])
    found = table(spark, sf, "events").where(F.col("event_type").isin(*FINDINGS))
    return found.select("event_id", F.col("user_id").alias("scan_id"), F.lower(F.try_element_at(kind, "event_type")).alias("vulnerability_type"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(redaction.redact(text), 256).alias("redacted_sha256"), redaction.secrets_found(text).alias("secrets_found"))


def secret_hits_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(redaction.secrets_found(F.col("text"))).alias("n_hits"))


def severity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.analytics(_reports(spark, sf))


def ci_gate(spark: SparkSession, sf: str) -> DataFrame:
    secrets = F.col("id") % 11 == 0
    text = F.coalesce("report_text", F.lit(""))
    rows = _reports(spark, sf).select("id", secrets.alias("secrets"), reports.with_banner(text, secrets).alias("report"))
    closed = reports.vulnerabilities_found(F.col("report"), F.col("secrets"))
    return rows.select(F.col("id").alias("request_id"), closed.alias("vulnerabilities_found"), reports.gate_severity(F.col("report"), F.col("secrets")).alias("severity_level"), closed.alias("build_failed"), F.char_length("report").alias("report_chars"))


def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), reports.cache_key(F.col("text"), F.lit(PROMPT)).alias("code_hash"), (F.col("doc_id") % 3 == 0).alias("is_fix"), F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("completed").alias("status"))
    return state.cache_hits(rows).select("id", "code_hash", "is_fix", "status", "hit", "hit_id")


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_counts(table(spark, sf, "documents"), "doc_id", text="text").select("doc_id", "token", "n", "total", (F.col("n") / F.col("total")).alias("tf"))


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.occurrences(table(spark, sf, "documents"), "doc_id", text="text")
    asked = retrieval.query_counts(table(spark, sf, "benchmark"), "item_id", "text")
    return retrieval.top_k(retrieval.scores(index, asked, "item_id", "doc_id"), "item_id", "doc_id", TOP_K)


def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf).select("item_id", "rank", "doc_id", "score")


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), F.col("text").alias("content"))
    built = retrieval.context(_retrieved(spark, sf).join(files, "doc_id"), "item_id")
    return built.select("item_id", F.char_length("context").alias("context_chars"), F.sha2("context", 256).alias("context_sha256"))


def compliance_score(spark: SparkSession, sf: str) -> DataFrame:
    scans = table(spark, sf, "customer").select(F.col("c_custkey").alias("scan_id"))
    return compliance.scores(scans, _findings(spark, sf))


def compliance_violations(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.violations(_findings(spark, sf)).select("event_id", "scan_id", "vulnerability_type", "soc2", "gdpr", "iso27001", "score_penalty")


def quota_admission(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return state.admitted_scans(requests, user="user_id", order=("ts", "event_id"), key="event_id", is_scan=F.col("event_type") == "view", premium=F.col("user_id") % 10 == 0, used=F.col("user_id") % 3).select("event_id", "user_id", "accepted")


def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.summary(table(spark, sf, "orders"), "o_orderstatus", "F").select("total", "healed", "resolution_rate")


def recent_scans(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.recent(table(spark, sf, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


def org_vault(spark: SparkSession, sf: str) -> DataFrame:
    """The vault of each organization once; a user's is that of the organization that ``user_profile`` gives."""
    owners = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("org_id"))
    vault = table(spark, sf, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("org_id", "o_orderkey", "o_orderdate")
    return dashboard.vault_by_org(vault, org="org_id", created="o_orderdate", key="o_orderkey").select("org_id", "o_orderkey", "position")


def user_profile(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("org_id"))
    return dashboard.profiles(users, table(spark, sf, "nation"), org="org_id", org_key="n_nationkey").select("c_custkey", "c_name", F.col("n_name").alias("org_name"))


def signup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    existing = table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return dashboard.conflicts(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), existing, "key")


def latest_job_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def webhook_route(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "click", "synchronize").when(F.col("event_type") == "error", F.lit(None)).otherwise("closed")
    body = F.to_json(F.struct(action.alias("action"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("number")).alias("pull_request")))
    routed = webhooks.route(table(spark, sf, "events").select("event_id", body.alias("payload")))
    return routed.select("event_id", "action", "pr_number", "routed")


def pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(reports.latin1(F.col("text")), 256).alias("sanitized_sha256"))


def responder_failover(spark: SparkSession, sf: str) -> DataFrame:
    """Four stub providers, each failing for some requests."""
    up = lambda name, every: F.when(F.col("event_id") % every != 0, F.lit(name))
    reply = responder.first_reply(up("first", 2), up("second", 3), up("third", 5), up("fourth", 7))
    return table(spark, sf, "events").select("event_id", reply.alias("provider"), F.when(reply.isNull(), 500).otherwise(200).alias("code"))


def retention(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 13 == 0, "raise-429").when(F.col("event_id") % 17 == 0, "raise-error").otherwise(F.col("props")).alias("code_snippet"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("vulnerability_type"), (F.col("event_type") == "purchase").alias("zero_retention"))
    return responder.enterprise(requests, responder.stub())[1]


def findings_by_window(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.finding_windows(table(spark, sf, "events"), "event_type").select(F.col("window_start").cast("timestamp_ntz"), "event_type", "n")


def findings_rollup(spark: SparkSession, sf: str) -> DataFrame:
    scans = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("vulnerability_type"), F.col("l_linestatus").alias("risk_level"))
    return dashboard.finding_counts(scans, "vulnerability_type", "risk_level").select("vulnerability_type", "risk_level", "n", F.col("level").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        redact_documents, secret_hits_by_source, severity_breakdown, ci_gate, cache_hits, term_frequency, retrieve_topk, prompt_context, compliance_score, compliance_violations, quota_admission, dashboard_summary,
        recent_scans, org_vault, user_profile, signup_conflicts, latest_job_state, webhook_route, pdf_text, responder_failover, retention, findings_by_window, findings_rollup,
    )
} | workflows.QUERIES | sql.QUERIES

_GENERIC = r"""(?i)(?:password|secret|api_key|token|auth)[\s\x1c-\x1f=:]+['"]([^'"]+)['"]""".replace("'", "''")
_REDACTED = f"""
 first AS (SELECT *, regexp_replace(text, '(?i)AKIA[0-9A-Z]{{16}}', '[REDACTED]', 'g') AS t1 FROM documents),
 second AS (SELECT *, regexp_replace(t1, '(?i)sk_live_[0-9a-zA-Z]{{24,}}', '[REDACTED]', 'g') AS t2 FROM first),
 parts AS (SELECT *, regexp_extract_all(t2, '{_GENERIC}', 0) AS g, regexp_extract_all(t2, '{_GENERIC}', 1) AS v, string_split_regex(t2, '{_GENERIC}') AS p FROM second),
 redacted AS (
  SELECT doc_id, source, regexp_matches(text, '(?i)AKIA[0-9A-Z]{{16}}') OR regexp_matches(t1, '(?i)sk_live_[0-9a-zA-Z]{{24,}}') OR len(g) > 0 AS found,
         CASE WHEN len(g) = 0 THEN t2 ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(g) THEN replace(g[i], v[i], '[REDACTED]') ELSE '' END), '') END AS r
  FROM parts)"""
_ORDERS = """
 reports AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN NULL ELSE replace(o_orderpriority, 'URGENT', 'CRITICAL') END AS t,
                    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_fix FROM orders)"""
_TYPES = """
 found AS (SELECT event_id, user_id AS scan_id, CASE event_type WHEN 'error' THEN 'hardcoded_secret' WHEN 'signup' THEN 'sql_injection' WHEN 'purchase' THEN 'xss' WHEN 'click' THEN 'insecure_eval_call' END AS vulnerability_type
           FROM events WHERE event_type IN ('error', 'signup', 'purchase', 'click')),
 dim(mapped, soc2, gdpr, iso27001, penalty) AS (VALUES {rows}),
 mapped AS (SELECT f.*, d.* FROM found f JOIN dim d ON d.mapped = CASE WHEN f.vulnerability_type IN (SELECT mapped FROM dim) THEN f.vulnerability_type ELSE 'default_vulnerability' END)""".format(
    rows=", ".join(str(row) for row in compliance.DIMENSION)
)
_WORDS = "list_transform(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: lower(x))"
_TERMS = f"""
 tok AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 tf AS (SELECT doc_id, token, count(*) AS n, any_value(total) AS total FROM (SELECT doc_id, len(w) AS total, unnest(w) AS token FROM tok) GROUP BY 1, 2)"""
_BEST = f"""{_TERMS},
 q AS (SELECT item_id, token, count(*) AS qn FROM (SELECT item_id, unnest({_WORDS}) AS token FROM benchmark) GROUP BY 1, 2),
 s AS (SELECT item_id, doc_id, sum(qn * n) / any_value(total) AS score FROM q JOIN tf USING (token) GROUP BY 1, 2),
 best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {TOP_K})"""
_BANNER_CHARS = len(reports.BANNER)

ORACLE_SQL = {
    "redact_documents": f"WITH {_REDACTED} SELECT doc_id, sha256(r) AS redacted_sha256, found AS secrets_found FROM redacted",
    "secret_hits_by_source": f"WITH {_REDACTED} SELECT source, count(*) AS n_docs, count(*) FILTER (found) AS n_hits FROM redacted GROUP BY 1",
    "severity_breakdown": f"""WITH {_ORDERS}, k AS (SELECT is_fix, CASE WHEN lower(t) LIKE '%critical%' THEN 1 WHEN lower(t) LIKE '%high%' THEN 2 WHEN lower(t) LIKE '%medium%' THEN 3
        WHEN regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])low([^\\p{{L}}\\p{{N}}_]|$)') THEN 4 END AS s FROM reports)
        SELECT count(*) FILTER (NOT is_fix) AS total_scans, count(*) FILTER (is_fix) AS total_fixes, count(*) FILTER (NOT is_fix AND s = 1) AS critical, count(*) FILTER (NOT is_fix AND s = 2) AS high,
        count(*) FILTER (NOT is_fix AND s = 3) AS medium, count(*) FILTER (NOT is_fix AND s = 4) AS low FROM k""",
    "ci_gate": f"""WITH {_ORDERS}, r AS (SELECT id, id % 11 = 0 AS sec, coalesce(t, '') AS t FROM reports),
        c AS (SELECT *, sec OR t LIKE '%CRITICAL%' OR t LIKE '%HIGH%' OR lower(t) LIKE '%vulnerabilities%' AS closed FROM r)
        SELECT id AS request_id, closed AS vulnerabilities_found, CASE WHEN sec OR t LIKE '%CRITICAL%' THEN 'CRITICAL' WHEN t LIKE '%HIGH%' THEN 'HIGH' WHEN t LIKE '%MEDIUM%' THEN 'MEDIUM' ELSE 'LOW' END AS severity_level,
        closed AS build_failed, CAST(length(t) + CASE WHEN sec THEN {_BANNER_CHARS} ELSE 0 END AS INTEGER) AS report_chars FROM c""",
    "cache_hits": f"""WITH r AS (SELECT doc_id AS id, sha256(text || '_{PROMPT}') AS code_hash, doc_id % 3 = 0 AS is_fix, CASE WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'completed' END AS status FROM documents),
        w AS (SELECT *, min(CASE WHEN status = 'completed' THEN id END) OVER (PARTITION BY code_hash, is_fix ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit_id FROM r)
        SELECT id, code_hash, is_fix, status, hit_id IS NOT NULL AS hit, hit_id FROM w""",
    "term_frequency": f"WITH {_TERMS} SELECT doc_id, token, n, CAST(total AS BIGINT) AS total, n / total AS tf FROM tf",
    "retrieve_topk": f"WITH {_BEST} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best",
    "prompt_context": f"""WITH {_BEST}, c AS (SELECT item_id, string_agg('--- File: doc-' || doc_id || ' ---' || chr(10) || text, chr(10) ORDER BY rank) AS c FROM best JOIN documents USING (doc_id) GROUP BY 1)
        SELECT item_id, CAST(length(c) AS INTEGER) AS context_chars, sha256(c) AS context_sha256 FROM c""",
    "compliance_score": f"""WITH {_TYPES}, p AS (SELECT scan_id, sum(penalty) AS p, count(*) AS n FROM mapped GROUP BY 1),
        s AS (SELECT c_custkey AS scan_id, CAST(greatest(0, 100 - coalesce(p, 0)) AS BIGINT) AS score, coalesce(n, 0) AS processed FROM customer LEFT JOIN p ON c_custkey = scan_id)
        SELECT scan_id, score, CASE WHEN score < 50 THEN 'CRITICAL FAIL (AUDIT BLOCKED)' WHEN score < 80 THEN 'AT RISK (REMEDIATION REQUIRED)' ELSE 'READY' END AS status, processed FROM s""",
    "compliance_violations": f"WITH {_TYPES} SELECT event_id, scan_id, vulnerability_type, soc2, gdpr, iso27001, penalty AS score_penalty FROM mapped",
    "quota_admission": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('view', 'click'))
        SELECT event_id, user_id, event_type = 'click' OR user_id % 10 = 0 OR user_id % 3 + rn <= 5 AS accepted FROM r""",
    "dashboard_summary": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS healed, count(*) FILTER (o_orderstatus = 'F') / count(*) * 100 AS resolution_rate FROM orders",
    "recent_scans": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
    "org_vault": """SELECT c_nationkey AS org_id, o_orderkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS position
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0""",
    "user_profile": "SELECT c_custkey, c_name, n_name AS org_name FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END",
    "signup_conflicts": "SELECT c_custkey AS key, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'conflict' ELSE 'new' END AS status FROM customer",
    "latest_job_state": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "webhook_route": """WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'error' THEN NULL ELSE 'closed' END AS action, CAST(props ->> '$.k' AS BIGINT) AS pr_number FROM events)
        SELECT event_id, action, pr_number, coalesce(action IN ('opened', 'synchronize'), false) AS routed FROM a""",
    "pdf_text": "SELECT doc_id, sha256(regexp_replace(text, '[^\\x{0}-\\x{FF}]', '?', 'g')) AS sanitized_sha256 FROM documents",
    "responder_failover": """WITH r AS (SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN 'first' WHEN event_id % 3 <> 0 THEN 'second' WHEN event_id % 5 <> 0 THEN 'third' WHEN event_id % 7 <> 0 THEN 'fourth' END AS provider FROM events)
        SELECT event_id, provider, CASE WHEN provider IS NULL THEN 500 ELSE 200 END AS code FROM r""",
    "retention": """SELECT event_id AS request_id, 'Enterprise_API_Payload' AS "fileName", CASE WHEN event_type = 'error' THEN 'Unknown Vulnerability' ELSE event_type END AS "vulnerabilityType", 'Critical' AS "riskLevel",
        CASE WHEN event_id % 13 = 0 THEN 'Rate Limit Exceeded' WHEN event_id % 17 = 0 THEN 'Error' ELSE 'Auto-Healed' END AS status FROM events WHERE event_type <> 'purchase'""",
    "findings_by_window": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "findings_rollup": "SELECT l_returnflag AS vulnerability_type, l_linestatus AS risk_level, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
} | workflows.ORACLE_SQL | sql.ORACLE_SQL
ORACLE_SQL["retrieve_stored"] = ORACLE_SQL["retrieve_topk"]
