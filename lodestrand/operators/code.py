"""Source code as relations: symbols, imports, calls and routes of Python files, and the edges between files and symbols.

Parsing is the one step that needs Python's own grammar; it runs on each file by itself inside tasks.  All that follows is
joins: imports to files by dotted module, calls to symbols by a cascade of rules of which the first that fits wins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.shared import written

FACTS = (
    "tag string, file string, name string, parent string, kind string, start_line int, end_line int, signature string, docstring string, "
    "decorators array<string>, returns_none boolean, raises array<string>, module string, names array<string>, locals array<string>, level int, callee string, path string, body_lines array<string>"
)
VERBS = frozenset(("get", "post", "put", "patch", "delete", "head", "options"))


def _dotted(node: ast.expr) -> str:
    """``ast.unparse`` of a name or of attributes of one without the unparser, which takes longer than parsing a file."""
    parts, inner = [], node
    while isinstance(inner, ast.Attribute):
        parts.append(inner.attr)
        inner = inner.value
    return ".".join([inner.id, *reversed(parts)]) if isinstance(inner, ast.Name) else ast.unparse(node)


def _columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows by columns, which takes a twentieth of ``from_pylist``."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _facts(file: str, content: str) -> list[dict]:
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError):
        return []
    out: list[dict] = []
    lines = content.splitlines() if content else []  # the line ends of ``split_lines``

    def function(node, parent: str | None) -> None:
        inner = list(ast.walk(node))
        returns = [n for n in inner if isinstance(n, ast.Return)]
        raised = list(dict.fromkeys(_dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for n in inner if isinstance(n, ast.Raise) and n.exc is not None))
        opening = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        out.append({
            "tag": "symbol", "name": node.name, "parent": parent, "kind": "method" if parent else "function", "start_line": node.lineno, "end_line": node.end_lineno,
            "signature": f"{opening} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""), "docstring": ast.get_docstring(node), "decorators": [_dotted(d) for d in node.decorator_list],
            "returns_none": any(r.value is None or isinstance(r.value, ast.Constant) and r.value.value is None for r in returns), "raises": raised[:8],
            "body_lines": lines[node.lineno - 1 : node.end_lineno],
        })
        whole = f"{parent}.{node.name}" if parent else node.name
        for call in (n for n in inner if isinstance(n, ast.Call)):
            text = _dotted(call.func)
            if len(text) < 80:
                out.append({"tag": "call", "name": whole, "callee": text, "start_line": call.lineno})
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS and d.args and isinstance(d.args[0], ast.Constant):
                out.append({"tag": "route", "name": whole, "kind": d.func.attr.upper(), "path": str(d.args[0].value), "start_line": node.lineno})

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
        elif isinstance(node, ast.ClassDef):
            out.append({"tag": "symbol", "name": node.name, "kind": "class", "start_line": node.lineno, "end_line": node.end_lineno, "signature": f"class {node.name}", "docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list]})
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(inner, node.name)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"tag": "import", "module": a.name, "names": [], "locals": [a.asname or a.name], "level": 0, "start_line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append({"tag": "import", "module": node.module or "", "names": [a.name for a in node.names], "locals": [a.asname or a.name for a in node.names], "level": node.level, "start_line": node.lineno})
    return [{"file": file} | fact for fact in out]


def parse_python(files: DataFrame) -> DataFrame:
    """One row for each fact of each Python file (columns path, language, content); a file that doesn't parse has none."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fact for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fact in _facts(path, content)]
            yield _columns(rows, schema)

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    whole = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.concat_ws(".", "parent", "name"))
    return facts.where("tag = 'symbol'").select("file", "name", whole.alias("qualified"), "parent", "kind", "start_line", "end_line", "signature", "docstring", "decorators", "returns_none", "raises", "body_lines")


def module_of(path: Column) -> Column:
    """Dotted module of a Python path; a package for its __init__."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def resolved_imports(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, line, module, original, local, base_file, own_file, resolved): a row for each imported name.

    base_file: the module itself, of a package that is its __init__; own_file: the module that the name is, if it is one.  A package
    from which one name is imported gives way to that name's module.  resolved is null for what isn't in the repository.
    """
    modules = files.where("language = 'python'").select(F.col("path").alias("hit"), module_of(F.col("path")).alias("target"))
    rows = facts.where("tag = 'import'").select("file", F.col("start_line").alias("line"), "module", "names", "locals", "level")
    parts = F.split(module_of(F.col("file")), "[.]")
    inside = F.when(F.col("file").endswith("/__init__.py"), F.size(parts) - F.col("level") + 1).otherwise(F.size(parts) - F.col("level"))
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(inside, F.lit(0))), F.nullif("module", F.lit("")))).otherwise(F.col("module"))
    rows = rows.withColumn("base", base).withColumn("pairs", F.when(F.size("names") > 0, F.arrays_zip("names", "locals")).otherwise(F.transform("locals", lambda x: F.struct(F.lit(None).cast("string").alias("names"), x.alias("locals")))))
    rows = rows.select("file", "line", "module", "base", F.size("names").alias("n_names"), F.explode_outer("pairs").alias("pair"))
    rows = rows.select("file", "line", "module", "base", "n_names", F.col("pair.names").alias("original"), F.col("pair.locals").alias("local"))
    found = lambda df, key, name: df.withColumn("target", key).join(modules.withColumnRenamed("hit", name), "target", "left").drop("target")
    rows = found(rows, F.col("base"), "base_file")
    # a dash in a module's name stands for an underscore where nothing has the name itself
    rows = found(rows, F.when(F.col("base_file").isNull(), F.replace("base", F.lit("-"), F.lit("_"))), "other").withColumn("base_file", F.coalesce("base_file", "other")).drop("other")
    rows = found(rows, F.when(F.col("original").isNotNull(), F.concat_ws(".", F.nullif("base", F.lit("")), F.col("original"))), "own_file")
    package = F.col("base_file").endswith("__init__.py") & (F.col("n_names") == 1)
    resolved = F.when(package, F.coalesce("own_file", "base_file")).otherwise(F.coalesce("base_file", F.when(F.col("base_file").isNull(), F.col("own_file"))))
    return rows.withColumn("resolved", resolved).drop("n_names", "base")


def file_edges(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst): files that a file imports; names that are modules of their own have edges of their own."""
    rows = resolved_imports(files, facts)
    edges = rows.select(F.col("file").alias("src"), F.explode(F.array("resolved", "own_file")).alias("dst"))
    return edges.where("dst is not null and src <> dst").distinct()


def aliases(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, local, target, original): what a local name stands for; the last import of a name wins."""
    rows = resolved_imports(files, facts)
    module = F.col("own_file").isNotNull() & ~F.coalesce(F.col("own_file") == F.col("base_file"), F.lit(False))
    target = F.when(module, F.col("own_file")).otherwise(F.col("resolved"))
    original = F.when(~module & (F.col("original") != "*"), F.col("original"))
    rows = rows.select("file", "local", "line", target.alias("target"), original.alias("original"))
    return rows.groupBy("file", "local").agg(F.max(F.struct("line", "target", "original")).alias("x")).select("file", "local", "x.target", "x.original")


def lookup(facts: DataFrame) -> DataFrame:
    """(key_file, key, symbol): a symbol by its whole name, or else the first in the file that has the bare name."""
    known = symbols(facts)
    both = known.select("file", F.col("qualified").alias("key"), F.lit(0).alias("prio"), (-F.col("start_line")).alias("at"), "qualified").union(known.select("file", "name", F.lit(1), "start_line", "qualified"))
    best = both.groupBy("file", "key").agg(F.min(F.struct("prio", "at", "qualified")).alias("x"))
    return best.select(F.col("file").alias("key_file"), "key", F.col("x.qualified").alias("symbol"))


def call_edges(files: DataFrame, facts: DataFrame, strict_parity: bool = False) -> DataFrame:
    """(caller_file, caller, callee_file, callee): calls resolved by a cascade of rules.

    Through self or cls: a method of the same class (under ``strict_parity`` a symbol of the module instead).  Dotted: the head is
    an imported name; its own symbol, else what follows in its file, else that in the module of the name.  Plain: a symbol of the
    same file, else an imported one, else the only symbol of that name in the repository.
    """
    look, known = lookup(facts), symbols(facts)
    calls = facts.where("tag = 'call'").select(F.monotonically_increasing_id().alias("call"), F.col("file").alias("caller_file"), F.col("name").alias("caller"), F.trim("callee").alias("text"))
    dotted, me = F.col("text").contains("."), F.col("text").rlike(r"^(self|cls)[.]")
    head, rest = F.substring_index("text", ".", 1), F.expr("substring(text, instr(text, '.') + 1)")
    calls = calls.select("*", me.alias("me"), dotted.alias("dotted"), head.alias("head"), rest.alias("rest"))
    calls = calls.join(aliases(files, facts).withColumnsRenamed({"file": "caller_file", "local": "head"}), ["caller_file", "head"], "left")

    def probe(df: DataFrame, file, key, when, name: str) -> DataFrame:
        keyed = df.withColumn("key_file", F.when(when, file)).withColumn("key", F.when(when, key))
        return keyed.join(look.withColumnRenamed("symbol", name), ["key_file", "key"], "left").withColumn(f"{name}_file", F.when(F.col(name).isNotNull(), F.col("key_file"))).drop("key_file", "key")

    own = F.col("rest") if strict_parity else F.concat_ws(".", F.substring_index("caller", ".", 1), "rest")
    me, plain, over = F.col("me"), ~F.col("dotted"), F.col("dotted") & ~F.col("me")
    out = probe(calls, F.col("caller_file"), own, me, "r1")
    if strict_parity:  # a whole name has to be meant
        out = out.withColumn("r1", F.when(F.col("r1") == F.col("rest"), F.col("r1")))
    out = probe(out, F.col("target"), F.coalesce("original", "rest"), over, "r2")
    out = probe(out, F.col("target"), F.col("rest"), over, "r3")
    modules = files.where("language = 'python'").select(module_of(F.col("path")).alias("sub"), F.col("path").alias("sub_file"))
    out = out.withColumn("sub", F.when(over & F.col("original").isNotNull(), F.concat_ws(".", module_of(F.col("target")), "original"))).join(modules, "sub", "left")
    out = probe(out, F.col("sub_file"), F.col("rest"), over, "r4")
    out = probe(out, F.col("caller_file"), F.col("text"), plain, "r5")
    out = probe(out, F.col("target"), F.col("original"), plain & F.col("original").isNotNull(), "r6")
    unique = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("r7_file"), F.min("qualified").alias("r7")).where("n = 1").drop("n")
    out = out.join(unique.withColumnRenamed("name", "text"), "text", "left").withColumn("r7", F.when(plain, F.col("r7"))).withColumn("r7_file", F.when(plain, F.col("r7_file")))
    rules = [f"r{i}" for i in range(1, 8)]
    out = out.select("caller_file", "caller", F.coalesce(*[f"{r}_file" for r in rules]).alias("callee_file"), F.coalesce(*rules).alias("callee"))
    return out.where("callee is not null").distinct()


_EVENTS = "file string, function string, at array<int>, event string, name string, line int, callee string, rank array<int>, text string"


class _Names(ast.NodeVisitor):
    """What functions do with names: read them, add to them, give them the result of a call, return them.

    An event belongs to every function around it.  rank: how deep a node stands and when it was met, which orders nodes level by level.
    """

    def __init__(self):
        self.around, self.depth, self.met, self.returned = [], 0, 0, None
        self.events: list[tuple] = []

    def visit(self, node: ast.AST) -> None:
        self.depth, self.met = self.depth + 1, self.met + 1
        super().visit(node)
        self.depth -= 1

    def emit(self, event: str, name: str, line: int, callee: str | None = None) -> None:
        rank = [*(self.returned or ()), self.depth, self.met]
        self.events += [(function, at, event, name, line, callee, rank) for function, at in self.around]

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.around.append((node.name, [node.lineno, node.col_offset]))
        self.generic_visit(node)
        self.around.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.emit("read" if self.returned is None else "returned", node.id, node.lineno)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.emit("added", node.target.id, node.lineno)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            self.emit("called", node.targets[0].id, node.lineno, node.value.func.id)
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        outer, self.returned = self.returned, (self.depth, self.met)
        self.generic_visit(node)
        self.returned = outer


def name_events(files: DataFrame) -> DataFrame:
    """A row for each event of a name in each function of the Python files that adds to a name; text: the line that adds."""

    def events_of(path: str, content: str) -> list[dict]:
        names = _Names()
        try:
            names.visit(ast.parse(content or ""))
        except (SyntaxError, ValueError, RecursionError):
            return []
        adding = {(e[0], *e[1]) for e in names.events if e[2] == "added"}
        lines = (content or "").splitlines() if adding else []
        rows = [dict(zip(("file", "function", "at", "event", "name", "line", "callee", "rank"), (path, *e), strict=True)) for e in names.events if (e[0], *e[1]) in adding]
        return [r | {"text": lines[r["line"] - 1]} if r["event"] == "added" and r["line"] <= len(lines) else r for r in rows]

    kinds = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _EVENTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _columns([r for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in events_of(path, content)], schema)

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, _EVENTS)


def unread(files: DataFrame) -> DataFrame:
    """(file, function, name, line, via, text): as ``dead_stores``, with the line that adds."""
    events, key = written(name_events(files)), ["file", "function", "at", "name"]
    added = events.where("event = 'added' and not startswith(name, '_')")
    left = added.join(events.where("event in ('read', 'returned')").select(key).distinct(), key, "left_anti")
    called = events.where("event = 'called'").groupBy(key).agg(F.max_by("callee", "rank").alias("callee"))
    returned = events.where("event = 'returned'").select(*key, "rank").join(called, key)
    via = returned.groupBy("file", "function", "at").agg(F.max_by("callee", "rank").alias("via"))
    return left.drop("callee").join(via, ["file", "function", "at"], "left").select("file", "function", "name", "line", "via", "text")


def dead_stores(files: DataFrame) -> DataFrame:
    """(file, function, name, line, via): names that a function adds up and never reads; via: the function whose result it returns instead."""
    return unread(files).drop("text")


_NAME = "[A-Za-z0-9_]"


def parse_scripts(files: DataFrame) -> DataFrame:
    """(file, kind, name, line, end_line, signature, target): functions, classes, imports and routes of JS, TS, Go and C-like files by patterns of their lines.

    A file's functions are methods from its first class on.  target: the module of an import or the path of a route, whose
    handler is ``name`` and whose verb is ``signature``.
    """
    script, go = F.col("language").isin("javascript", "typescript"), F.col("language") == "go"
    code = files.where(~F.col("language").isin("python", "markdown", "rst", "text", "json", "yaml", "toml", "ini", "env", "sql", "shell"))
    rows = code.select(F.col("path").alias("file"), "language", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("pos", "line"), F.size(F.split("content", "\r\n|\n|\r")).alias("n"))
    take = lambda pattern, k=1: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    function = rf"^\s*(?:export\s+)?(?:async\s+)?function\s+({_NAME}+)\s*\(([^)]*)\)"
    arrow = rf"^\s*(?:export\s+)?const\s+({_NAME}+)\s*=\s*(?:async\s*)?\(([^)]*)\)"
    klass, gofunc = rf"^\s*(?:export\s+)?class\s+({_NAME}+)", rf"^func\s+(?:\([^)]*\)\s*)?({_NAME}+)\s*\("
    other = rf"^\s*(?:public|private|protected|static|final|async|\s)*[A-Za-z0-9_<>\[\]]+\s+({_NAME}+)\s*\([^;]*\)\s*\{{?\s*$"
    stripped = F.trim("line")
    rows = rows.select(
        "*", (F.col("pos") + 1).alias("at"),
        F.when(script, F.coalesce(take(function), take(arrow))).when(go, take(gofunc)).otherwise(F.when(~take(other).isin("if", "for", "while", "switch", "catch", "return"), take(other))).alias("function"),
        F.when(script, F.coalesce(F.when(take(function).isNotNull(), F.regexp_extract("line", function, 2)), F.when(take(arrow).isNotNull(), F.regexp_extract("line", arrow, 2)))).alias("params"),
        F.when(script & take(function).isNull() & take(arrow).isNull(), take(klass)).alias("class"),
        F.when(script, F.coalesce(*[take(p) for p in (r"^import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"^import\s+['\"]([^'\"]+)['\"]", rf"^const\s+{_NAME}+\s*=\s*require\(['\"]([^'\"]+)['\"]\)", rf"^\s*import\s+({_NAME}[A-Za-z0-9_.]*)")])).when(go, F.nullif(F.regexp_extract(stripped, r'^"([^"]+)"$', 1), F.lit(""))).alias("module"),
        F.when(script, F.regexp_extract_all("line", F.lit(rf"((?:app|router|server|api)\.(?:get|post|put|delete|patch)\(\s*['\"][^'\"]+['\"]\s*,\s*(?:.*?,\s*)?{_NAME}+\s*\))"), F.lit(1))).alias("routes"),
    )
    along = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("classed", F.count("class").over(along) > 0).withColumn("block", F.last(F.when(stripped.isin("import (", ")"), stripped), ignorenulls=True).over(along))
    size = F.when(go | ~script, 3).otherwise(4)
    signature = F.when(script, F.concat(F.lit("function "), "function", F.lit("("), F.col("params"), F.lit(")"))).otherwise(F.substring(stripped, 1, 100))
    made = rows.where("function is not null").select("file", F.when(F.col("classed") & script, "method").otherwise("function").alias("kind"), F.col("function").alias("name"), F.col("at").alias("line"), F.least(F.col("at") + size, F.col("n")).alias("end_line"), signature.alias("signature"), F.lit(None).cast("string").alias("target"))
    classes = rows.where("class is not null").select("file", F.lit("class"), "class", "at", "at", F.concat(F.lit("class "), "class"), F.lit(None))
    imports = rows.where(F.col("module").isNotNull() & (script | (F.col("block") == "import ("))).select("file", F.lit("import"), F.substring_index("module", "/", -1), "at", "at", F.lit(None), "module")
    each = rows.select("file", "at", F.explode("routes").alias("route"))
    routed = each.select("file", F.lit("route"), F.regexp_extract("route", rf"({_NAME}+)\s*\)$", 1), "at", "at", F.upper(F.regexp_extract("route", r"^[a-z]+\.([a-z]+)", 1)), F.regexp_extract("route", r"['\"]([^'\"]+)['\"]", 1))
    return made.union(classes).union(imports).union(routed)
