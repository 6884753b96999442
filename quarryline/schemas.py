"""Schemas of the engine's tables, as DDL, and their constraints."""

from __future__ import annotations

ORGANIZATION = "id INT, name STRING, invite_code STRING"
USERS = "id INT, email STRING, is_premium BOOLEAN, scan_count INT, api_key STRING, webhook_url STRING, org_id INT, org_role STRING"
SCAN_CACHE = "id INT, code_hash STRING, report_text STRING, is_fix BOOLEAN, status STRING, job_id STRING, created_at TIMESTAMP_NTZ"
CODE_VAULT = "id INT, org_id INT, vulnerable_code STRING, secure_code STRING, created_at TIMESTAMP_NTZ"
SCAN = "id STRING, fileName STRING, vulnerabilityType STRING, riskLevel STRING, status STRING, createdAt TIMESTAMP_NTZ"
SCAN_REQUEST = "request_id BIGINT, ts TIMESTAMP_NTZ, email STRING, kind STRING, code STRING, filename STRING"
CODE_FILE = "repo_id STRING, filename STRING, content STRING, seq BIGINT"
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

#: Columns whose non-null values must differ between rows, and (column, table, column) references.
UNIQUE = {"organization": ("name", "invite_code"), "users": ("email", "api_key"), "scan_cache": ("job_id",)}
REFERENCES = {"users": (("org_id", "organization", "id"),), "code_vault": (("org_id", "organization", "id"),)}
STATUSES = ("pending", "completed", "failed")
#: The engine's tables by name.
TABLES = {"organization": ORGANIZATION, "users": USERS, "scan_cache": SCAN_CACHE, "code_vault": CODE_VAULT, "scan": SCAN, "scan_request": SCAN_REQUEST, "code_file": CODE_FILE}
