"""Analytics over scans and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.reports import fixed_1, severity_of_report
from quarryline.names import fresh
from quarryline.operators.pieces import HOT_ROWS, numbered

HEALED = "Auto-Healed"


def analytics(cache: DataFrame) -> DataFrame:
    """One row: total_scans, total_fixes, critical, high, medium, low. A null is_fix is neither scan nor fix."""
    scan = ~F.col("is_fix")
    level = F.when(scan, severity_of_report(F.col("report_text")))
    return cache.agg(F.count_if(scan).alias("total_scans"), F.count_if("is_fix").alias("total_fixes"), *[F.count_if(level == name).alias(name.lower()) for name in ("Critical", "High", "Medium", "Low")])


def summary(scans: DataFrame, status: str = "status", healed: str = HEALED) -> DataFrame:
    """One row: total, healed, resolution_rate (percent) and its text with one decimal; 0.0 for no rows."""
    rate = F.coalesce(F.try_divide(F.col("healed"), F.col("total")) * 100, F.lit(0.0))
    return scans.agg(F.count("*").alias("total"), F.count_if(F.col(status) == healed).alias("healed")).withColumn("resolution_rate", rate).withColumn("resolution_text", fixed_1(F.col("resolution_rate")))


def recent(scans: DataFrame, created: str, key: str, n: int = 5) -> DataFrame:
    """The last n rows; ties by key, the larger first."""
    return scans.orderBy(F.col(created).desc(), F.col(key).desc()).limit(n)


def vault_by_org(vault: DataFrame, *, org: str, created: str, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The vault rows of each organization, newest first by ``position``, once for all of its users. A large organization is numbered by many tasks."""
    return numbered(vault, by=org, at=created, ties=key, name="position", hot_rows=hot_rows)


def vault_of_user(users: DataFrame, vault: DataFrame, *, org: str, created: str, key: str) -> DataFrame:
    """The vault rows of the users who ask, newest first by ``position``; users without an organization have none.

    The result has a row for each user and row of the vault: for all users at
    once, take ``vault_by_org`` and the users' organizations.
    """
    return users.join(vault_by_org(vault, org=org, created=created, key=key), org)


def members(organizations: DataFrame, users: DataFrame, vault: DataFrame, *, org: str, org_key: str) -> DataFrame:
    """Organizations with n_users and n_vault, 0 where they have none; both sides are counted before they are joined."""
    n_users, n_vault = fresh("n_users", organizations), fresh("n_vault", organizations)
    counted = lambda df, name: df.where(F.col(org).isNotNull()).groupBy(F.col(org).alias(org_key)).agg(F.count("*").alias(name))
    return organizations.join(counted(users, n_users), org_key, "left").join(counted(vault, n_vault), org_key, "left").fillna(0, [n_users, n_vault])


def profiles(users: DataFrame, organizations: DataFrame, *, org: str, org_key: str) -> DataFrame:
    """Users with their organization, null where they have none."""
    return users.join(organizations, F.col(org) == F.col(org_key), "left")


def conflicts(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The candidates with status conflict (their key is taken) or new."""
    name = fresh("taken", candidates)
    taken = existing.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return candidates.join(taken, key, "left").withColumn("status", F.when(F.col(name), "conflict").otherwise("new")).drop(name)


def authenticated(requests: DataFrame, users: DataFrame, key_prefix: str) -> tuple[DataFrame, DataFrame]:
    """(requests with their user, requests that nobody matches): by api_key where the credential has the prefix, else by email."""
    by_key, kind = F.col("credential").startswith(key_prefix), fresh("kind", requests)
    keyed = requests.withColumn(kind, F.when(by_key, "key").otherwise("email"))
    ids = users.select(F.explode(F.array(F.struct(F.lit("key").alias(kind), F.col("api_key").alias("credential")), F.struct(F.lit("email").alias(kind), F.col("email").alias("credential")))).alias("c"), F.struct(*users.columns).alias("user")).select("c.*", "user")
    on = [kind, "credential"]
    return keyed.join(ids, on).drop(kind), keyed.join(ids, on, "left_anti").drop(kind)


def finding_counts(scans: DataFrame, *keys: str) -> DataFrame:
    """Extension: counts by all combinations of the keys, with their totals."""
    return scans.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, rule, n: rows that break uniqueness or references (see schemas)."""
    from quarryline.schemas import REFERENCES, UNIQUE

    found = []
    row = lambda df, table, column, rule: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(rule).alias("rule"), "n")
    for table, columns in UNIQUE.items():
        for c in columns if table in tables else ():
            found.append(row(tables[table].where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1"), table, c, "unique"))
    for table, references in REFERENCES.items():
        for c, other, key in references if table in tables else ():
            missing = tables[table].where(F.col(c).isNotNull()).join(tables[other].select(F.col(key).alias(c)), c, "left_anti")
            found.append(row(missing.select(F.lit(1).alias("n")), table, c, f"references {other}"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
