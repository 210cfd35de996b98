"""Detectors, reviews, navigation and planning on small hand-made inputs; each test names the operators of the survey that it is for."""

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import chunks, code, detect, diffs, graph, navigate, planner, review

SOURCE = '''import hashlib
from shop.store import find_item


@router.get("/items/{key}")
def show(key, rate=0.2, fee: float = 1):
    item = find_item(key)
    other = query_all()
    if other is None:
        return
    return item["name"], other.x * rate


@router.post("/items")
def make(body):
    try:
        name, size = body["name"], body.get("size")
        validate(body, "name")
        return run(f"select {name}", 'x')
    except Exception: pass


def load(rows=[], key=None):
    if rate > 1:
        fee = 2
    for row in rows:
        db.execute(f"SELECT * FROM t WHERE id = {row}")
        db.execute("second of the same loop")
    db.execute(f"DELETE FROM {TABLE}")
    cursor.execute("SELECT " + key)
    total, _seen = 0, 0
    total += 1
    _seen += 1
    best = helper(rows)
    if key == None or eval(key): # TODO both on one line
        subprocess.run(key, shell=True)
    return best


def helper(fee):
    # FIXME later
    password = hashlib.md5(fee)
    return password
'''
STORE = "def find_item(key):\n    return None\n\nclass Box:\n    def find_item(self):\n        return self.other()\n    def other(self):\n        return 1\n"
TEST = "from shop.app import load\n\ndef test_all():\n    assert load() and 'find_item'\n"


@pytest.fixture(scope="module")
def shop(spark):
    rows = [("shop/__init__.py", "python", ""), ("shop/app.py", "python", SOURCE), ("shop/store.py", "python", STORE), ("tests/test_app.py", "python", TEST), ("notes.md", "markdown", "# Notes\npassword = 'abcdefghi'"), ("set.ini", "ini", "token = 'abcdefghi'")]
    files = spark.createDataFrame(rows, "path string, language string, content string").cache()
    facts = code.parse_python(files).cache()
    return files, facts, code.symbols(facts).cache(), facts.where("tag = 'route'").cache()


def lines(df, **kept):
    return sorted((r.line, r.category) for r in df.collect())


def test_line_rules(shop):
    """K2 to K5, B7."""
    files, _, symbols, routes = shop
    only = files.where("path = 'shop/app.py'")
    at = {t: i for i, t in enumerate(SOURCE.split("\n"), 1)}
    line = lambda part: next(i for t, i in at.items() if part in t)
    assert lines(detect.sql_injection(only, symbols, routes)) == sorted([(line("f\"select {name}"), "sql_injection"), (line("WHERE id = {row}"), "sql_injection"), (line('"SELECT " + key'), "sql_injection")])
    assert lines(detect.swallowed_errors(only, symbols, routes)) == [(line("except Exception: pass"), "swallowed_error")]
    assert lines(detect.dangerous_calls(only, symbols, routes)) == [(line("eval(key)"), "dangerous_call"), (line("shell=True"), "dangerous_call")]
    assert lines(detect.quality(only, symbols, routes)) == [(line("def load"), "mutable_default"), (line("== None"), "style"), (line("FIXME"), "todo"), (line("md5(fee)"), "weak_crypto")]


def test_body_rules(shop):
    """K1, K6 to K10, K16, E7, E9, C9, G3."""
    files, _, symbols, routes = shop
    found = {(r.category, r.title) for r in detect.run_checks(files, symbols, routes).where("file = 'shop/app.py'").collect()}
    assert ("unhandled_none", "Possible None dereference: `item` is used without a None check") in found and not any("`other`" in t for _, t in found)
    assert ("missing_error_handling", "GET /items/{key}: handler has no error handling") in found and not any(t.startswith("POST /items: handler") for _, t in found)
    assert ("missing_input_validation", "POST /items: field(s) used without validation: size") in found
    assert {t for c, t in found if c == "missing_validation"} == {"`rate` is used without range validation", "`fee` is used without range validation"}
    assert [(r.name, r.via) for r in code.dead_stores(files).collect()] == [("total", "helper")]
    loops = detect.queries_in_loops(files, symbols, routes).collect()
    assert len(loops) == 1 and "WHERE id" in loops[0].snippet
    assert {r.category for r in detect.run_checks(files, symbols, routes, ["quality"]).collect()} == {"mutable_default", "style", "todo", "weak_crypto"}


DIFF = """--- a/shop/app.py
+++ b/shop/app.py
@@ -1,4 +22,9 @@
-def load(rows, key, old=1):
-    check = verify_token(key)
+def load(rows=[], key=None):
+    secret = "abcdefghijklmn"
+    token = os.environ["x"] or "abcdefghijklmn"
+    for row in rows:
+        if row == None:
+            session.query(row)
+            session.query(row)
+    except Exception:
     kept
--- a/tests/test_app.py
+++ b/tests/test_app.py
@@ -1 +1 @@
+def test_more(): eval(1)  # TODO
--- a/new.py
+++ b/new.py
@@ -0,0 +1,2 @@
+def fresh():
+    return 1
"""


def test_review(spark, shop):
    """L1 to L10, C12, C13, C19, E8."""
    files, facts, symbols, _ = shop
    tests = navigate.tests_of(files, symbols, code.resolved_imports(files, facts))
    assert {(r.path, r.test) for r in tests.collect()} == {("shop/app.py", "tests/test_app.py"), ("shop/store.py", "tests/test_app.py")}
    rows = diffs.parse(spark.createDataFrame([(1, DIFF)], "diff_id long, diff string"))
    got = {(r.file, r.line, r.category) for r in review.review(spark.createDataFrame([(1, DIFF)], "diff_id long, diff string"), files, symbols, tests).collect()}
    assert {("shop/app.py", 22, "mutable_default"), ("shop/app.py", 23, "hardcoded_secret"), ("shop/app.py", 26, "style"), ("shop/app.py", 27, "n_plus_one"), ("shop/app.py", 29, "swallowed_error"), ("shop/app.py", 22, "breaking_change"), ("shop/app.py", 22, "removed_auth")} <= got
    assert ("shop/app.py", 28, "n_plus_one") not in got and ("shop/app.py", 24, "hardcoded_secret") not in got
    assert {("tests/test_app.py", 1, "dangerous_call"), ("tests/test_app.py", 1, "todo"), ("new.py", 1, "missing_tests")} <= got and ("shop/app.py", 22, "missing_tests") not in got
    assert any(c == "sql_injection" and f == "shop/app.py" for f, _, c in got)  # of the repository, near added lines
    ranked = review.review(spark.createDataFrame([(1, DIFF)], "diff_id long, diff string"), files, symbols, tests).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, len(ranked) + 1)) and [r.severity for r in ranked] == sorted((r.severity for r in ranked), key=("HIGH", "MEDIUM", "LOW").index)
    assert review.long_functions(rows, symbols, 5).where("file = 'shop/app.py'").count() == 1 and review.long_functions(rows, symbols).count() == 0


def test_navigation(spark, shop):
    """C7, C8, C10, C17, C26, I4, I9, F8."""
    files, facts, symbols, routes = shop
    names = spark.createDataFrame([("find_item",), ("LOAD",), ("Box.other",), ("nothing",)], "name string")
    got = {(r.name, r.qualified) for r in navigate.find_symbols(symbols, names).collect()}
    assert got == {("find_item", "find_item"), ("find_item", "Box.find_item"), ("LOAD", "load"), ("Box.other", "Box.other")}
    hints = spark.createDataFrame([(1, "/items/", None), (2, "/items/{key}/more", "post"), (3, "items", "get"), (4, "/zzz", None)], "hint_id long, hint string, verb string")
    assert {(r.hint_id, r.verb, r.path) for r in navigate.find_routes(routes, hints).collect()} == {(1, "POST", "/items"), (2, "POST", "/items"), (3, "GET", "/items/{key}")}
    calls = code.call_edges(files, facts)
    starts = routes.where("kind = 'GET'").select(F.lit("t").alias("trace"), "file", F.col("name").alias("handler"))
    assert [(r.depth, r.symbol) for r in navigate.trace_routes(starts, calls, symbols).orderBy("ord").collect()] == [(0, "show"), (1, "find_item")]
    assert {(r.callee, r.caller) for r in navigate.callers_of(calls).collect()} >= {("helper", "load"), ("find_item", "show")}
    assert {(r.path, r.direction, r.other) for r in navigate.direct_neighbours(code.file_edges(files, facts)).collect()} >= {("shop/app.py", "dependency", "shop/store.py"), ("shop/store.py", "dependent", "shop/app.py")}
    said = {r.path: r.summary for r in navigate.file_summaries(files, symbols).collect()}
    assert said["shop/store.py"] == "shop/store.py: function find_item, class Box, method Box.find_item, method Box.other" and said["notes.md"] == "notes.md"


def test_ordered_trace_goes_level_by_level(spark):
    """I4, 2.Z-4: first visit wins, neighbours in order; cycles end."""
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "e"), ("c", "a"), ("e", "f"), ("d", "e")], "src string, dst string")
    walk = graph.ordered_trace(edges, spark.createDataFrame([(1, "a")], "trace int, node string"), 2).orderBy("ord").collect()
    assert [(r.node, r.depth) for r in walk] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)]


def test_chunks_and_search(spark, shop):
    """J1, J2, J8 to J10, J12, C15, C16, C18, D4."""
    files, facts, symbols, routes = shop
    rows = chunks.chunk(files, symbols, routes, code.resolved_imports(files, facts).select("file", "line", "module"), code.file_edges(files, facts)).withColumn("chunk", F.concat_ws(" ", "id", "file")).cache()
    text = {r.id: r.text for r in rows.collect()}
    helper = next(i for i in text if i.startswith("sym:shop/app.py:helper:"))
    assert "abcdefghi" not in text["doc:set.ini"] and text["doc:notes.md"].startswith("doc: notes.md\n") and text[helper].split("\n")[:3] == ["file: shop/app.py", "function helper", "def helper(fee)"]
    assert "depends on: shop/store.py" in text["file:shop/app.py"] and text["route:GET:/items/{key}"].startswith("endpoint: GET /items/{key}\nhandler: show def show(key")
    ask = spark.createDataFrame([(1, "where is helper zzzunseen"), (2, "how are rows loaded")], "query_id long, text string")
    routed = spark.createDataFrame([(2, "shop/app.py", "make")], "query_id long, file string, handler string")
    hits = chunks.hybrid_search(rows, ask, routed).collect()
    first = {r.query_id: r.chunk for r in hits if r["rank"] == 1}
    assert first == {1: f"{helper} shop/app.py", 2: "route:POST:/items shop/app.py"} and all(r.score > 0.02 for r in hits)
    assert any("HTTP endpoint definition" in r.reason for r in hits) and any("module structure overview" in r.reason for r in hits)
    near = chunks.expand(spark.createDataFrame([(1, "file:shop/app.py shop/app.py", 1)], "query_id long, chunk string, rank int"), rows, rows.select(F.lit(1).cast("long").alias("query_id"), "chunk", F.lit(1.0).alias("score")), code.file_edges(files, facts)).collect()
    assert {r.chunk.split()[0] for r in near} == {r for r in text if r.startswith("sym:shop/store.py")} and {r.score for r in near} == {0.55}


def test_planner(spark, shop):
    """O1, O2, P1, P2, P5, P6, A7, A10, D12, D13, K0."""
    ask = {"Please review this": "review", "add tests for `load`": "testgen", "Describe the project": "analyst", "why 500?": "investigate", "where is it": "search", "hello": "search", "preview": "search"}
    got = spark.createDataFrame([(q,) for q in ask], "q string").select("q", planner.intent(F.col("q")).alias("i"), planner.target(F.col("q")).alias("t")).collect()
    assert {r.q: r.i for r in got} == ask and {r.q: r.t for r in got}["add tests for `load`"] == "load"
    symbols = shop[2]
    kinds = {(r.function, r.name): (r.kind, r.annotation, r.default) for r in planner.parameters(symbols).collect()}
    assert kinds["show", "rate"] == ("rate", "", "0.2") and kinds["show", "fee"] == ("rate", "float", "1") and kinds["make", "body"][0] == "mapping" and kinds["load", "rows"] == ("iterable", "", "[]") and ("find_item", "self") not in kinds
    made = {(r.function, r.label): (r.call, r.expectation) for r in planner.cases(symbols).collect()}
    assert made["show", "test_invalid_rate_negative"] == ('show(key="sample-value-123", rate=-0.5, fee=1)', "raises") and made["other", "test_other_smoke"][0] == "other()" and ("load", "test_large_rows") in made
    assert planner.guards(symbols).where("function = 'helper'").first().code == '    if not 0 <= fee <= 1:\n        raise ValueError("fee must be between 0 and 1")'
    out = "FAILED t.py::test_neg - Failed: DID NOT RAISE\nFAILED t.py::test_normal - AssertionError: x\nERROR broken.py\n2 failed, 3 passed, 1 error in 1s"
    runs = spark.createDataFrame([(1, out)], "run long, output string")
    total = runs.select(planner.test_totals(F.col("output")).alias("t")).first().t
    assert (total.passed, total.failed, total.errors, total.failed_tests) == (3, 2, 1, ["t.py::test_neg", "t.py::test_normal", "broken.py"])
    assert {(r.label, r["class"]) for r in planner.failure_classes(runs, "run", "output").collect()} == {("test_normal", "value_bug"), ("test_neg", "missing_validation"), ("broken.py", "crash")}
    rows = [("a", ["x", "y"], ["y", "z", "x"], ["Y"], "y"), ("a", [], ["z"], [], ""), ("b", ["q"], [], ["no"], "yes")]
    marked = planner.marks(spark.createDataFrame(rows, "category string, gold array<string>, found array<string>, keywords array<string>, answer string"), 2)
    assert [(r.recall, r.citation, r.keyword_hit) for r in marked.collect()] == [(0.5, 2 / 3, True), (None, None, True), (0.0, None, False)]
    assert planner.markdown(planner.report(marked)).first().text.split("\n")[2:] == ["| a | 2 | 0.5 | 0.5 |", "| b | 1 | 0.0 | 0.0 |"]
    aspects = {(r.aspect, r.value): r.n for r in planner.summary(shop[0]).collect()}
    assert aspects["language", "python"] == 4 and aspects["size", "tests"] == 1 and aspects["size", "files"] == 6
