import pytest

from quarryline.operators import hotspots

NONE = [
    "let password = `x`", "password = 'x'", "({password:'x'})", "const {password} = 'x'", "window.eval(x)", "new eval(x)", "// eval(x)", '"eval(x)"', "/* eval(x) */", "let api_key = 'x'", "let token = 'x'",
    "let password = 'x' + y", "let password = 'x'.trim()", "let password = ('x')", "var a = /eval(x)/.test(b)", "`eval(x)`", "eval", "eval`x`", "function eval(x) {}", "eval(x", "let password", "let password = 5", "x?.eval(1)", "let password = 'unterminated", "class A { eval(x) { } }", "", None,
]


@pytest.mark.parametrize("code", NONE)
def test_no_hotspot(code):
    assert hotspots.scan(code) == []


ONE = [
    ("const db_password = 'x'; console.log(db_password);", ("hardcoded_secret", "db_password = 'x'", 1, 1, "High")),
    ("eval(input)", ("insecure_eval_call", "eval(input)", 1, 1, "Critical")),
    ("let a = '1', MySecret = \"2\"", ("hardcoded_secret", 'MySecret = "2"', 1, 1, "High")),
    ("a\n\neval(\n a\n)", ("insecure_eval_call", "eval(\n a\n)", 3, 5, "Critical")),
    ("let a = f(b, [c, d]), secret = 'x'", ("hardcoded_secret", "secret = 'x'", 1, 1, "High")),
    ("let secret = 'x'\nfoo()", ("hardcoded_secret", "secret = 'x'", 1, 1, "High")),
    ("let {a, b} = c, password = 'x'", ("hardcoded_secret", "password = 'x'", 1, 1, "High")),
    ("`${eval(x)}`", ("insecure_eval_call", "eval(x)", 1, 1, "Critical")),
    ("`a ${`b ${eval('}')} c`} d`", ("insecure_eval_call", "eval('}')", 1, 1, "Critical")),
    ("let x = a / eval(b) / c", ("insecure_eval_call", "eval(b)", 1, 1, "Critical")),
    ("const r = /[/'\"]/; var secret = 'it\\'s'", ("hardcoded_secret", "secret = 'it\\'s'", 1, 1, "High")),
    ("if (eval(x)) { }", ("insecure_eval_call", "eval(x)", 1, 1, "Critical")),
    ("} } ) eval(x)", ("insecure_eval_call", "eval(x)", 1, 1, "Critical")),
    ("var t=\"</p>\";track(0);let PASSWORD_é='ü'", ("hardcoded_secret", "PASSWORD_é='ü'", 1, 1, "High")),
]


@pytest.mark.parametrize("code,want", ONE)
def test_one_hotspot(code, want):
    assert hotspots.scan(code) == [want]


def test_nested():
    got = hotspots.scan("eval(function () {\n let password = 'x';\n return eval(1) })")
    assert [(h[0], h[2], h[3]) for h in got] == [("insecure_eval_call", 1, 3), ("hardcoded_secret", 2, 2), ("insecure_eval_call", 3, 3)]


def test_in_spark(spark):
    files = spark.createDataFrame([(1, "eval(a); var secret = 's'"), (2, None), (3, "x")], "id int, code string")
    got = hotspots.hotspots(files, "id")
    assert [(r.id, r.pos, r.node_type) for r in got.orderBy("pos").collect()] == [(1, 0, "insecure_eval_call"), (1, 1, "hardcoded_secret")]
    patches = spark.createDataFrame([(1, 1, "fixed")], "id int, hotspot_index int, suggested_code string")
    assert [r.suggested_code for r in hotspots.patched(got, patches, "id").orderBy("pos").collect()] == [None, "fixed"]
    hotspots.register_udtf(spark)
    assert spark.sql("SELECT * FROM scan_js('eval(1)')").first().risk_level == "Critical"
