"""Investigations, search answers and the repository report on a small repository, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import answer as A
from lodestrand.operators import code, detect
from lodestrand.operators import investigate as I
from lodestrand.operators import navigate as N

FILES = {
    "shop/__init__.py": "",
    "shop/auth/tokens.py": "def encode_token(claims):\n    return str(claims)\n",
    "shop/routes/cart.py": 'from fastapi import APIRouter\nfrom shop.services import pricing\nrouter = APIRouter()\n\n@router.post("/cart/total")\ndef cart_total(body):\n    return pricing.total_cart(body["items"], body["rate"])\n\n@router.head("/cart")\ndef cart_head():\n    return None\n',
    "shop/services/pricing.py": "from shop.data.db import find_price\n\ndef total_cart(items, rate):\n    spent = 0\n    for item in items:\n        spent += item\n    row = find_price(rate)\n    value = compute(row)\n    print(row[0])\n    return value\n\ndef compute(x):\n    return x\n",
    "shop/data/db.py": 'def find_price(rate):\n    cursor.execute(f"SELECT * FROM p WHERE r = {rate}")\n    return None\n',
    "shop/public.py": 'PUBLIC = ["/health", \'/cart/total\', "/cart/total"]\nAGAIN = "/cart/total"\n',
    "tests/test_pricing.py": "from shop.services.pricing import total_cart\n\ndef test_total():\n    assert total_cart([1], 0)\n",
    "conf/app.ini": 'password = "hunter2hunter2"\n',
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([(p, "python" if p.endswith(".py") else "ini", c) for p, c in FILES.items()], "path string, language string, content string").cache()
    facts = code.parse_python(files).cache()
    symbols, routes = code.symbols(facts).cache(), facts.where("tag = 'route'").cache()
    imports = code.resolved_imports(files, facts)
    return files, facts, symbols, routes, code.call_edges(files, facts).cache(), N.tests_of(files, symbols, imports).cache(), code.file_edges(files, facts).cache()


def test_head_and_options_are_routes(repo):
    assert {(r.kind, r.path) for r in repo[3].collect()} == {("POST", "/cart/total"), ("HEAD", "/cart")}


def test_investigations(spark, repo):
    files, _, symbols, routes, calls, tests, _ = repo
    asked = spark.createDataFrame([(1, "Why does POST /cart/total/ return HTTP 500 for a discount rate?"), (2, "why a 404 at /cart/total"), (3, "is the password secret leaked"), (4, "why /nowhere fails")], "query_id long, question string")
    hits = spark.createDataFrame([(3, "conf/app.ini", 1), (3, "shop/data/db.py", 2), (4, "shop/services/pricing.py", 1), (1, "conf/app.ini", 1)], "query_id long, file string, rank int")
    secrets = spark.createDataFrame([("conf/app.ini", 1, "assigned_secret", "assigned secret")], "file string, line int, kind string, title string")
    findings, reports = I.investigate(asked, files, symbols, routes, calls, tests, secrets, hits)
    got, said = {}, {r.query_id: r for r in reports.collect()}
    for r in findings.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.category, r.file, r.line, r.relevance))
    one = got[1]
    assert [c for c, *_ in one][:2] == ["unhandled_none", "sql_injection"] or [c for c, *_ in one][:2] == ["sql_injection", "unhandled_none"]
    assert {"missing_error_handling", "dead_store", "missing_validation", "missing_input_validation"} <= {c for c, *_ in one} and len(one) == 8 < said[1].n_findings
    assert got[2][-1][:3] == ("path_reference", "shop/public.py", 1)
    assert not {"unhandled_none", "missing_error_handling"} & {c for c, *_ in got[2]}  # another status was stated
    assert [x[:3] for x in got[3]][:2] == [("exposed_secret", "conf/app.ini", 1), ("sql_injection", "shop/data/db.py", 2)] and got[3][0][3] == 1
    assert {f for _, f, _, _ in got[4]} == {"shop/services/pricing.py"}
    assert (said[1].verb, said[1].path, said[1].status, said[1].tests) == ("POST", "/cart/total", "500", "tests/test_pricing.py")
    assert said[1].chain.split("\n")[0] == "0 cart_total shop/routes/cart.py:6" and said[1].files.split() == ["shop/routes/cart.py", "shop/services/pricing.py", "shop/data/db.py"]
    assert said[4].path is None and said[4].files == "shop/services/pricing.py" and said[2].n_findings == len(got[2])


def test_rationale_names_the_call_that_is_returned_instead(repo):
    files, _, symbols, routes, *_ = repo
    found = {r.category: r.rationale for r in detect.run_checks(files, symbols, routes).collect()}
    assert "the value actually returned is computed by `compute(...)` instead" in found["dead_store"] and "in total_cart()" in found["dead_store"]
    assert "`row` is assigned from `find_price(rate)` which can return None (assignment at line 7); line 9" in found["unhandled_none"]
    assert all(found.values())


def plain_answer(hits, callers, known, tests, wants_tests):
    """Citations after the graph's own, in order."""
    cites, seen = [], set()
    for file, symbol in hits:
        if "test" not in file and file not in seen and len(cites) < 5:
            cites.append((file, symbol))
            seen.add(file)
    out, added = [f for f, _ in cites], 0
    for file, symbol in cites:
        if added >= 2 or symbol is None or symbol.startswith("test_"):
            continue
        for c_file, c_symbol in sorted(callers.get((file, symbol), ()))[:2]:
            if c_file in seen or "test" in c_file or (c_file, c_symbol) not in known:
                continue
            out.append(c_file)
            seen.add(c_file)
            added += 1
    if wants_tests and cites:
        out += sorted(tests.get(cites[0][0], ()))[:2]
    return out[:8]


def test_search_answers_stop_like_a_loop(spark):
    rng = random.Random(5)
    paths = [f"app/m{i}.py" for i in range(9)] + ["tests/test_a.py", "tests/test_b.py"]
    known = [(p, f"f{k}") for p in paths for k in range(3)]
    callers, tests = {}, {p: {t for t in paths[-2:] if rng.random() < 0.6} for p in paths[:-2]}
    for callee in known:
        callers[callee] = {rng.choice(known) for _ in range(rng.randrange(4))} | ({("app/m0.py", "gone")} if rng.random() < 0.2 else set())
    files = spark.createDataFrame([(p, "python", "\n" * 20) for p in paths], "path string, language string, content string")
    symbols = spark.createDataFrame([(p, s, s, 3, 30) for p, s in known], "file string, name string, qualified string, start_line int, end_line int")
    calls = spark.createDataFrame([(c, s, f, n) for (f, n), of in callers.items() for c, s in of], "caller_file string, caller string, callee_file string, callee string")
    covering = spark.createDataFrame([(p, t) for p, of in tests.items() for t in of], "path string, test string")
    asked, hits, want = [], [], {}
    for q in range(60):
        wants = q % 3 == 0
        asked.append((q, "are there tests for this" if wants else "where is it"))
        own = [rng.choice(known) if rng.random() < 0.8 else (rng.choice(paths), None) for _ in range(8)]
        hits += [(q, i + 1, f, 1, 9, s, "x") for i, (f, s) in enumerate(own)]
        want[q] = plain_answer(own, callers, set(known), tests, wants)
    none = spark.createDataFrame([], "src string, dst string")
    got = A.search_answers(spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(hits, "query_id long, rank int, file string, start_line int, end_line int, symbol string, reason string"), files, symbols, calls, none, covering)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.file)
    assert found == {q: w for q, w in want.items() if w} and any(len(w) > 6 for w in want.values())


def test_dependency_answers(spark, repo):
    files, _, symbols, _, calls, tests, edges = repo
    asked = spark.createDataFrame([(1, "who calls total_cart in the shop"), (2, "which files import shop/data/db.py?"), (3, "what does shop/routes/cart.py depend on"), (4, "what does the services layer import"), (5, "where is nothing")], "query_id long, question string")
    none = spark.createDataFrame([], "query_id long, rank int, file string, start_line int, end_line int, symbol string, reason string")
    got = {}
    for r in A.search_answers(asked, none, files, symbols, calls, edges, tests).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.file, r.start_line, r.symbol, r.reason))
    assert got[1] == [("shop/routes/cart.py", 6, "cart_total", "calls total_cart (shop/services/pricing.py)"), ("tests/test_pricing.py", 3, "test_total", "calls total_cart (shop/services/pricing.py)")]
    assert got[2] == [("shop/services/pricing.py", 1, None, "imports shop/data/db.py (import find_price)")]
    assert ("shop/services/pricing.py", 2, None, "dependency of shop/routes/cart.py (from shop.services import pricing)") in got[3]
    assert got[4] == [("shop/data/db.py", 1, None, "dependency of shop/services/pricing.py (from shop.data.db import find_price)")] and 5 not in got
    named = A.named_symbols(spark.createDataFrame([(1, "see `TOTAL_CART` and def compute"), (2, "plain")], "query_id long, question string"), symbols)
    assert {(r.query_id, r.qualified) for r in named.collect()} == {(1, "total_cart"), (1, "compute")}


def test_report(repo):
    files, _, symbols, routes, *_ = repo
    lines = [r.text for r in A.repository_report(files, symbols, routes).orderBy("line_no").collect()]
    assert len(lines) == 12 and lines[0] == "Languages: python (7 files)" and lines[1] == "Frameworks: FastAPI"
    assert lines[4] == "Authentication: shop/auth/ (shop/auth/tokens.py)" and lines[5] == "API: shop/routes/ (shop/routes/cart.py)" and lines[8] == "Models: (not found) ()"
    assert lines[9] == "Tests: tests/test_pricing.py" and lines[11].endswith(f"{symbols.count()} symbols, 2 HTTP endpoints.")
    assert lines[7].startswith("Data access: shop/data/ (shop/data/db.py)") and F is not None
