"""Every query of the catalogue against its SQL, and plans that must hold."""

import duckdb
import pytest

from quarryline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    return None if x is None or x != x else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(map(cell, r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    got = sorted((tuple(map(cell, r)) for r in df.select(*columns).collect()), key=key)
    assert got == want


def test_all_are_registered(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_redaction_stays_in_generated_code(spark):
    text = plan(catalog.redact_documents(spark, SF))
    assert "Python" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_top_k_limits_before_the_shuffle(spark):
    assert plan(catalog.retrieve_topk(spark, SF)).count("WindowGroupLimit") >= 2
    assert plan(catalog.quota_admission(spark, SF)).count("WindowGroupLimit") >= 2


def test_every_finding_event_is_mapped_and_scored(spark, duck):
    """Against counts of the whole table, not ORACLE_SQL."""
    penalty = "CASE event_type WHEN 'error' THEN 25 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 20 ELSE 10 END"
    found = f"SELECT event_id, user_id, {penalty} AS penalty FROM events WHERE event_type IN ('error', 'signup', 'purchase', 'click')"
    got = catalog.compliance_violations(spark, SF).select("event_id", "scan_id", "score_penalty").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(found).fetchall())
    of_user = f"SELECT c_custkey, greatest(0, 100 - coalesce(sum(penalty), 0)), count(penalty) FROM customer LEFT JOIN ({found}) ON user_id = c_custkey GROUP BY 1"
    got = catalog.compliance_score(spark, SF).select("scan_id", "score", "processed").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(of_user).fetchall())
