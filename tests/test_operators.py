"""The operators on small fixtures with results worked out by hand."""

import random

from pyspark.sql import functions as F

from quarryline.functions.reports import AT_RISK, NOT_READY, READY
from quarryline.operators import compliance, dashboard, hotspots, responder, retrieval, state, webhooks
from quarryline.sources import sinks, tables

FILES = [
    ("r", "shop/cart.js", "export const total = items => items.map(price).reduce(sum); // items, total", 1),
    ("r", "shop/price.js", "const price = item => item.net * rate", 2),
    ("r", "notes.txt", "Nothing to do with money here.", 3),
]


def retrieve(spark, files, text, k=2, repo="r"):
    files = spark.createDataFrame(files, "repo_id string, filename string, content string, seq long")
    return retrieval.retrieve(files, spark.createDataFrame([(1, text)], "query_id int, code string"), repo=repo, k=k)


def test_retrieval(spark):
    # cart.js: export const total items items map price reduce sum items total (11); price.js: const price item item net rate (6)
    got = retrieve(spark, FILES, "total_of(items, price, items)").orderBy("rank").collect()
    assert [(r.filename, r.score) for r in got] == [("shop/cart.js", (2 + 2 * 3 + 1) / 11), ("shop/price.js", 1 / 6)]
    text = retrieval.context(retrieve(spark, FILES, "total_of(items, price, items)")).first().context
    assert text.startswith("--- File: shop/cart.js ---\nexport const") and "\n--- File: shop/price.js ---\n" in text
    assert retrieve(spark, FILES, "a bc").count() == 0
    assert retrieve(spark, FILES, "token", repo="other").count() == 0


def test_retrieval_ties_and_reingestion(spark):
    files = [("r", "b", "same words", 1), ("r", "a", "same words", 2), ("r", "c", "other", 3), ("r", "b", "words same", 4), ("r", None, "same words", 5), ("r", "e", None, 6)]
    got = retrieve(spark, files, "same", k=3).orderBy("rank").collect()
    assert [(r.filename, r.content) for r in got] == [("b", "words same"), ("a", "same words"), ("unknown.py", "same words")]


ITEMS = [
    ('[{"type":"hardcoded_secret"},{"type":"sql_injection","description":"d"},{"type":"unknown_bug"},"text"]', 35, NOT_READY, 3),
    ("[]", 100, READY, 0),
    ('{"type":"xss"}', 100, READY, 0),
    ("not json", 100, READY, 0),
    (None, 100, READY, 0),
    ('[{"type":"xss"}]', 80, READY, 1),
    ('[{"type":"hardcoded_secret"}]', 75, AT_RISK, 1),
    ('[{"type":"xss"},{"type":"sql_injection"}]', 50, AT_RISK, 2),
    ('[{"type":"sql_injection"},{"type":"sql_injection"},{"type":"sql_injection"},{"type":"sql_injection"}]', 0, NOT_READY, 4),
    ('[{"type":null},{"type":5},null,7]', 100, READY, 0),
    ('[{"description":"only"}]', 90, READY, 1),
    ('[{"type":"SQL_Injection"},{"type":"insecure_eval_call"}]', 60, AT_RISK, 2),
]


def test_compliance(spark):
    scans = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ITEMS)], "scan_id int, items string")
    found = compliance.items(scans)
    got = compliance.scores(scans, found).orderBy("scan_id").collect()
    assert [(r.score, r.status, r.processed) for r in got] == [x[1:] for x in ITEMS]
    report = compliance.reports(scans, found).where("scan_id = 0").first()
    assert [v.vulnerability_type for v in report.compliance_violations] == ["hardcoded_secret", "sql_injection", "unknown_bug"]
    assert [v.description for v in report.compliance_violations] == [compliance.NO_DESCRIPTION, "d", compliance.NO_DESCRIPTION]
    assert report.compliance_violations[2].regulatory_impact.SOC_2.startswith("CC7.1")


def test_explicit_null_description(spark):
    scans = spark.createDataFrame([(1, '[{"type":"xss","description":null}]')], "scan_id int, items string")
    assert compliance.items(scans).first().description is None


def test_quota_against_a_sequence(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(12), rng.random() < 0.6) for i in range(600)]
    counts, want = {}, {}
    for i, user, scan in rows:
        n = counts.setdefault(user, user % 3)
        want[i] = not scan or user % 10 == 0 or n < 5
        counts[user] = n + want[i]
    requests = spark.createDataFrame(rows, "id int, user int, scan boolean")
    got = state.admitted_scans(requests, user="user", order=("id",), key="id", is_scan=F.col("scan"), premium=F.col("user") % 10 == 0, used=F.col("user") % 3)
    assert {r.id: r.accepted for r in got.collect()} == want


def test_cache_and_jobs(spark):
    rows = spark.createDataFrame([(1, "h", False, "pending", "a"), (2, "h", False, "completed", "b"), (3, "h", False, "completed", "c"), (4, "h", True, "completed", "d"), (5, "h", None, "completed", "e")], "id int, code_hash string, is_fix boolean, status string, report_text string")
    assert [r.hit_id for r in state.cache_hits(rows).orderBy("id").collect()] == [None, None, 2, None, None]
    asked = spark.createDataFrame([(1, "h", False), (2, "h", True), (3, "x", False)], "r int, code_hash string, is_fix boolean")
    hits, misses = state.cached(asked, rows)
    assert sorted((r.r, r.report_text) for r in hits.collect()) == [(1, "b"), (2, "d")] and [r.r for r in misses.collect()] == [3]
    events = spark.createDataFrame([("j", 1, "pending", None), ("j", 2, "completed", "t"), ("k", 1, "failed", "e")], "job_id string, seq int, status string, report_text string")
    assert sorted(tuple(r) for r in state.job_status(state.latest(events, "job_id", "seq")).collect()) == [("j", "completed", "t"), ("k", "failed", None)]


def test_memberships_and_turns(spark):
    events = spark.createDataFrame([(1, 7, "create", 1), (1, 8, "join", 2), (2, 7, "join", 3)], "user_id int, org_id int, action string, seq int")
    assert sorted(tuple(r) for r in state.memberships(events).collect()) == [(1, 8, "developer"), (2, 7, "developer")]
    rows = spark.createDataFrame([("f", i) for i in range(5)], "file_name string, pos int")
    assert [r.key_index for r in state.round_robin(rows, 2, "pos").orderBy("pos").collect()] == [0, 1, 0, 1, 0]


def test_dashboard(spark):
    cache = spark.createDataFrame([("CRITICAL", False), ("low", False), ("x", False), ("high", True), ("high", None), (None, False)], "report_text string, is_fix boolean")
    assert tuple(dashboard.analytics(cache).first()) == (4, 1, 1, 0, 0, 1)
    empty = spark.createDataFrame([], "status string")
    assert tuple(dashboard.summary(empty).first()) == (0, 0, 0.0, "0.0")
    scans = spark.createDataFrame([("Auto-Healed" if i < 3 else "Pending",) for i in range(2000)], "status string")
    assert dashboard.summary(scans).first().resolution_text == "0.1"


def test_tenancy(spark):
    users = spark.createDataFrame([("a", "k_1", 1), ("b", None, None)], "email string, api_key string, org_id int")
    orgs = spark.createDataFrame([(1, "o")], "id int, name string")
    assert sorted((r.email, r.name) for r in dashboard.profiles(users, orgs, org="org_id", org_key="id").collect()) == [("a", "o"), ("b", None)]
    vault = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 12, 7)], "org_id int, id int, created_at int")
    assert sorted((r.email, r.id, r.position) for r in dashboard.vault_of_user(users, vault, org="org_id", created="created_at", key="id").collect()) == [("a", 10, 2), ("a", 11, 1)]
    asked = spark.createDataFrame([("k_1",), ("b",), ("k_2",), ("c",)], "credential string")
    known, unknown = dashboard.authenticated(asked, users, "k_")
    assert sorted(r.user.email for r in known.collect()) == ["a", "b"] and sorted(r.credential for r in unknown.collect()) == ["c", "k_2"]
    fresh = spark.createDataFrame([("a",), ("z",), (None,)], "email string")
    assert sorted((str(r.email), r.status) for r in dashboard.conflicts(fresh, users, "email").collect()) == [("None", "new"), ("a", "conflict"), ("z", "new")]


def test_constraints(spark):
    orgs = spark.createDataFrame([(1, "o", "x"), (2, "o", "y")], "id int, name string, invite_code string")
    users = spark.createDataFrame([("a", None, 1), ("b", None, 3)], "email string, api_key string, org_id int")
    got = {(r.table, r.column): r.n for r in dashboard.constraint_violations({"organization": orgs, "users": users}).collect()}
    assert got == {("organization", "name"): 2, ("organization", "invite_code"): 0, ("users", "email"): 0, ("users", "api_key"): 0, ("users", "org_id"): 1}


def test_stored_tables(spark, tmp_path):
    from quarryline.schemas import STATUSES, TABLES

    rows = [(1, "h", "r", False, STATUSES[1], "j"), (2, "h", "r", False, STATUSES[0], "j")]
    spark.createDataFrame(rows, "id int, code_hash string, report_text string, is_fix boolean, status string, job_id string").write.json(f"{tmp_path}/scan_cache")
    cache = tables.stored(spark, str(tmp_path), "scan_cache", "json")
    assert cache.schema == spark.createDataFrame([], TABLES["scan_cache"]).schema
    assert [(r.id, r.hit_id) for r in state.cache_hits(cache).orderBy("id").collect()] == [(1, None), (2, 1)]
    assert [(r.column, r.n) for r in dashboard.constraint_violations({"scan_cache": cache}).collect()] == [("job_id", 2)]


def test_responder(spark):
    found = spark.createDataFrame([("f", 0, "hardcoded_secret", "High", "a"), ("f", 1, "x", "High", "raise-429"), ("f", 2, "x", "High", "raise-error")], "file_name string, pos int, node_type string, risk_level string, code_snippet string")
    scans, patches = responder.heal(found, responder.stub())
    assert [r.status for r in scans.collect()] == ["Auto-Healed", "Rate Limit Exceeded - Pending", "Pending"]
    assert [(r.hotspot_index, r.suggested_code.startswith("fixed ")) for r in patches.collect()] == [(0, True)]
    empty_reply = lambda df: df.withColumns({"reply": F.lit(" \n"), "error": F.lit(None).cast("string")})
    scans, patches = responder.heal(found, empty_reply)
    assert {r.status for r in scans.collect()} == {"Auto-Healed"} and patches.count() == 0
    asked = spark.createDataFrame([(1, "a", None, True), (2, "raise-429", "x", False), (3, "raise-error", None, None)], "request_id int, code_snippet string, vulnerability_type string, zero_retention boolean")
    answers, rows = responder.enterprise(asked, responder.stub())
    assert [r.status for r in answers.orderBy("request_id").collect()] == ["Auto-Healed", "Rate Limit Exceeded", "Error"]
    assert [(r.request_id, r.vulnerabilityType) for r in rows.orderBy("request_id").collect()] == [(2, "x"), (3, "Unknown Vulnerability")]
    answers, rows = responder.enterprise(asked, responder.stub(), online=False)
    assert {r.status for r in answers.collect()} == {"Error"} and rows.count() == 0


def test_routing(spark):
    bodies = ['{"action":"opened","pull_request":{"number":7},"repository":{"full_name":"o/r"}}', '{"action":"synchronize"}', '{"action":"closed"}', "{}", "broken"]
    got = webhooks.route(spark.createDataFrame([(b,) for b in bodies], "payload string")).collect()
    assert [(r.pr_number, r.repository, r.routed) for r in got] == [(7, "o/r", True), (None, None, True), (None, None, False), (None, None, False), (None, None, False)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("x = 1\ny = 2\n")
    assert [r.content for r in tables.code_files(spark, str(tmp_path / "code"), "r").collect()] == ["x = 1\ny = 2\n"]
    asked = spark.createDataFrame([(1, "r", [{"filename": "f", "content": "c"}, {"content": "d"}])], "request_id long, repo_id string, files array<map<string,string>>")
    assert [(r.filename, r.content) for r in tables.ingest_requests(asked).orderBy("seq").collect()] == [("f", "c"), ("unknown.py", "d")]
    saved = spark.createDataFrame([("javascript", " ", "a/b"), ("python", "x", "a\\c.js")], "language string, code string, path string")
    assert tables.saved_files(saved).count() == 1 and [r.filename for r in tables.scan_commands(saved).collect()] == ["c.js"]
    rows = spark.range(3).select("id")
    for _ in range(2):
        sinks.append_once(str(tmp_path / "out"))(rows, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    sinks.append(rows, str(tmp_path / "more"))
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    rows.write.json(str(tmp_path / "json"))
    assert tables.csv(spark, str(tmp_path / "csv"), "id long").count() == tables.json(spark, str(tmp_path / "json"), "id long").count() == 3
    tries = spark.createDataFrame([(1, 1, None, True), (2, 1, "e", True), (3, 3, "e", True), (4, 1, "e", False)], "id int, attempt int, error string, transient boolean")
    assert [[r.id for r in df.collect()] for df in sinks.retried(tries)] == [[1], [2], [3, 4]]
    finished = spark.createDataFrame([("a", "r" * 2000)], "email string, report_text string")
    users = spark.createDataFrame([("a", "http://x"), ("b", None)], "email string, webhook_url string")
    assert [(r.url, len(r.payload)) for r in sinks.webhook_rows(finished, users).collect()] == [("http://x", 1500)]


def test_defaults_only_where_a_key_is_missing(spark):
    asked = spark.createDataFrame([(1, "r", [{"filename": "f", "content": None}, {}])], "request_id long, repo_id string, files array<map<string,string>>")
    assert [(r.filename, r.content) for r in tables.ingest_requests(asked).orderBy("seq").collect()] == [("f", None), ("unknown.py", "")]


def test_files_keep_the_order_of_ingestion(spark, tmp_path):
    import os

    for i, name in enumerate(["b.py", "a.py", "c.py"]):
        (tmp_path / name).write_text("same words")
        os.utime(tmp_path / name, (10**9 + i, 10**9 + i))
    found = retrieval.retrieve(tables.code_files(spark, str(tmp_path), "r"), spark.createDataFrame([(1, "same")], "query_id int, code string"), repo="r")
    assert [os.path.basename(r.filename) for r in found.orderBy("rank").collect()] == ["b.py", "a.py", "c.py"]


def test_helper_columns_do_not_clash(spark):
    extra = [F.lit("own").alias(c) for c in ("first", "n", "within", "last", "taken", "kind", "penalties", "number")]
    rows = spark.createDataFrame([(1, "h", False, "completed", 1), (2, "h", False, "completed", 1)], "id int, code_hash string, is_fix boolean, status string, user int").select("*", *extra)
    assert {(r.first, r.hit_id) for r in state.cache_hits(rows).select("first", "hit_id").collect()} == {("own", None), ("own", 1)}
    assert state.latest(rows, "code_hash", "id").first()["last"] == "own"
    judged = state.admitted_scans(rows, user="user", order=("id",), key="id", is_scan=F.lit(True), premium=F.lit(False), used=F.lit(4))
    assert sorted((r.id, r.n, r.within, r.accepted) for r in judged.collect()) == [(1, "own", "own", True), (2, "own", "own", False)]
    assert {r.taken for r in dashboard.conflicts(rows.withColumn("email", F.lit("a")), spark.createDataFrame([("a",)], "email string"), "email").collect()} == {"own"}


def test_connections_are_tried_again():
    waits, tries = [], []

    def connect(fail):
        tries.append(1)
        if len(tries) <= fail:
            raise OSError("unreachable")
        return "up"

    assert tables.connected(lambda: connect(2), sleep=waits.append) == "up" and waits == [5.0, 5.0]
    tries.clear()
    waits.clear()
    try:
        tables.connected(lambda: connect(9), sleep=waits.append)
    except OSError:
        assert len(tries) == 5 and len(waits) == 4
    try:
        tables.connected(lambda: int("x"), sleep=waits.append)
    except ValueError:
        assert len(waits) == 4


def test_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    rows.write.format("jdbc").options(url=url, dbtable="numbers", driver=driver).save()
    whole = tables.connected(lambda: tables.database(spark, url, "numbers", driver=driver))
    parted = tables.database(spark, url, "numbers", key="id", low=0, high=1000, driver=driver)
    assert parted.rdd.getNumPartitions() == tables.CONNECTIONS
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect())) == sorted(map(tuple, rows.collect()))


def test_long_scripts_take_linear_steps():
    """Lines of the scanner that are run, which no other work on the machine changes."""
    import sys

    def steps(n):
        run = 0

        def line(frame, event, _):
            nonlocal run
            run += event == "line"
            return line

        scripts = ["eval(" * n + "x" + ")" * n, "let secret = 'x';\n" * n]
        sys.settrace(line)
        try:
            found = [len(hotspots.scan(s)) for s in scripts]
        finally:
            sys.settrace(None)
        assert found == [n, n]
        return run

    assert steps(1600) < 10 * steps(200)


def test_terms_are_counted_once_per_row(spark):
    """Each row by itself, also of equal keys; the text is cut into tokens once, not again in a filter."""
    texts = ["Beta alpha beta ALPHA beta", None, "", "ab c", "\u00c9t\u00e9 \u00e9t\u00e9 x1y", "gamma " * 3000, "one"]
    rows = [(n % 5, t) for n, t in enumerate(texts)]
    counts = retrieval.term_counts(spark.createDataFrame(rows, "id int, content string"), "id")
    found = [(k, [w for w in (t or "").lower().split() if len(w) >= 3]) for k, t in rows]
    assert sorted(map(tuple, counts.collect())) == sorted((k, w, words.count(w), len(words)) for k, words in found for w in set(words))
    assert counts._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") == 1
