"""A small repository of our own: symbols, imports, calls, routes, dead stores."""

import pytest

from lodestrand.operators import code
from lodestrand.sources.tables import scan_repository

FILES = {
    "svc/__init__.py": "# package\n", "svc/core/__init__.py": "# package\n", "svc/api/__init__.py": "# package\n",
    "svc/core/store.py": 'def open_db():\n    return 1\n\ndef fetch_one(key):\n    """One row."""\n    open_db()\n    if not key:\n        return None\n    raise KeyError(key)\n',
    "svc/core/accounts.py": "from svc.core import store\n\ndef get_account(name):\n    total = 0\n    total += 1\n    return store.fetch_one(name)\n",
    "svc/api/accounts.py": 'from ..core import accounts\n\n@router.get("/v1/accounts/{name}")\ndef show(name):\n    return accounts.get_account(name)["id"]\n',
    "svc/core/klass.py": "import os\n\nclass Pool:\n    def take(self):\n        return self.grow()\n\n    def grow(self):\n        return 2\n",
    "broken.py": "def (:\n", ".env": "KEY=1\n", "svc/empty/__init__.py": "", "node_modules/x.py": "x = 1\n", "Dockerfile": "FROM scratch\n",
    "web/a.ts": "import b from './lib/b'\nexport async function go(x, y) {\n  return x\n}\nexport class Box {\n  const late = () => 1\n}\nrouter.post('/v1/items', check, go)",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = scan_repository(spark, str(root)).cache()
    return files, code.parse_python(files).cache()


def test_symbols_and_routes(repo):
    _, facts = repo
    got = {(r.file, r.qualified, r.kind): r for r in code.symbols(facts).collect()}
    assert ("svc/core/klass.py", "Pool.take", "method") in got and ("svc/core/klass.py", "Pool", "class") in got and len(got) == 7
    one = got["svc/core/store.py", "fetch_one", "function"]
    assert one.returns_none and one.raises == ["KeyError"] and one.docstring == "One row." and one.signature == "def fetch_one(key)" and (one.start_line, one.end_line) == (4, 9)
    assert [(r.kind, r.path, r.name) for r in facts.where("tag = 'route'").collect()] == [("GET", "/v1/accounts/{name}", "show")]


def test_edges(repo):
    files, facts = repo
    assert {(r.src, r.dst) for r in code.file_edges(files, facts).collect()} == {("svc/core/accounts.py", "svc/core/store.py"), ("svc/api/accounts.py", "svc/core/accounts.py")}
    calls = {(r.caller, r.callee_file, r.callee) for r in code.call_edges(files, facts).collect()}
    assert calls == {("fetch_one", "svc/core/store.py", "open_db"), ("get_account", "svc/core/store.py", "fetch_one"), ("show", "svc/core/accounts.py", "get_account"), ("Pool.take", "svc/core/klass.py", "Pool.grow")}
    assert "Pool.take" not in {r.caller for r in code.call_edges(files, facts, strict_parity=True).collect()}


def test_scan_reads_packages_and_dotfiles(repo):
    rows = {r.path: r for r in repo[0].collect()}
    assert set(rows) == (set(FILES) - {"node_modules/x.py"}) and rows["svc/__init__.py"].lines == 2 and rows[".env"].language == "env" and rows["svc/empty/__init__.py"].lines == 0
    assert rows["Dockerfile"].language is None and rows["web/a.ts"].language == "typescript"


def test_imports_that_resolve_to_nothing_stay(repo):
    got = {(r.file, r.local): (r.resolved, r.own_file) for r in code.resolved_imports(*repo).collect()}
    assert got["svc/core/accounts.py", "store"] == ("svc/core/store.py", "svc/core/store.py") and got["svc/core/klass.py", "os"] == (None, None)


def test_scripts(repo):
    got = {(r.kind, r.name, r.line, r.end_line, r.signature, r.target) for r in code.parse_scripts(repo[0]).where("file = 'web/a.ts'").collect()}
    assert got == {
        ("import", "b", 1, 1, None, "./lib/b"), ("function", "go", 2, 6, "function go(x, y)", None), ("class", "Box", 5, 5, "class Box", None), ("method", "late", 6, 8, "function late()", None),
        ("route", "go", 8, 8, "POST", "/v1/items"),
    }


def test_dead_stores(repo):
    assert [tuple(r) for r in code.dead_stores(repo[0]).collect()] == [("svc/core/accounts.py", "get_account", "total", 5, None)]
