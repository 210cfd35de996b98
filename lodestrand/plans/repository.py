"""A source repository that Spark derives from ``documents``, one file a document, and the queries over it.

Each document becomes a module, a test, a script, a page of text or a settings file, by its id, with all of its own text in it.  One
list of expressions gives the files' content in Spark and in DuckDB, so both engines read the same repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import code, detect
from lodestrand.operators.shared import written
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}
#: The document whose module a module imports.
_NEXT = "(cast(floor(doc_id / 3) as bigint) + 1)"
_PYTHON = [
    f"concat('from app.pkg', {_NEXT} % 20, '.mod_', {_NEXT}, ' import load_', {_NEXT})", "'import os'", "case when doc_id % 6 = 0 then 'from fastapi import APIRouter' end", "case when doc_id % 30 = 0 then 'import sqlite3' end", "''",
    "concat('@router.post(\"/items/', doc_id % 40, '\")')", "concat('def create_', doc_id, '(body, rate=0.1):')", "'    name = body[\"name\"]'", "case when doc_id % 2 = 0 then '    validate(body, \"name\")' end",
    "'    qty = body.get(\"qty\")'", "'    row = find_user(name)'", "case when doc_id % 3 = 0 then '    if row is None:' end", "case when doc_id % 3 = 0 then '        return' end",
    "case when doc_id % 10 = 0 then '    try:' end", "case when doc_id % 10 = 0 then '        qty = int(qty)' end", "case when doc_id % 10 = 0 then '    except ValueError:' end", "case when doc_id % 10 = 0 then '        raise' end",
    "'    total = row[\"x\"] * rate'", "case when doc_id % 5 = 0 then '    total = 0 if rate > 1 else total' end", f"concat('    return load_', {_NEXT}, '(total)')", "'# end'",
    "concat('def load_', doc_id, case when doc_id % 4 = 0 then '(items=[], other=None):' else '(items, other=None):' end)", "'    out = 0'", "'    spent = 0'", "'    for item in items:'", "'        spent += item'",
    "case when doc_id % 4 = 1 then '        db.execute(f\"SELECT * FROM t WHERE id = {item}\")' end", "case when doc_id % 4 = 2 then '        db.execute(f\"SELECT * FROM {TABLE}\")' end", "case when doc_id % 6 = 0 then '    eval(other)' end",
    "case when doc_id % 7 = 0 then '    try: out = 1' end", "case when doc_id % 7 = 0 then '    except Exception: pass' end", "case when doc_id % 8 = 0 then '    if other == None: out = 2' end",
    "case when doc_id % 12 = 0 then '    # TODO tidy' end", "case when doc_id % 15 = 0 then '    digest = hashlib.md5(b\"x\")' end", "case when doc_id % 30 = 0 then '    password = os.environ' end",
    "concat('    return helper_', doc_id % 50, '(out)')", "'# end'", "case when doc_id % 3 = 1 then concat('def helper_', doc_id % 50, '(x):') end", "case when doc_id % 3 = 1 then '    return x' end", "case when doc_id % 3 = 1 then '# end' end",
]
_TEST = [f"concat('from app.pkg', {_NEXT} % 20, '.mod_', {_NEXT}, ' import load_', {_NEXT})", "concat('def test_load_', doc_id, '():')", f"concat('    assert load_', {_NEXT}, '([1]) == 1')", "'# end'"]
_SCRIPT = [f"concat('import next from \"./mod_', {_NEXT}, '\"')", "concat('export function run_', doc_id, '(a, b) {')", "'  return a'", "'}'", "'class Box {'", "'}'", "concat('const go_', doc_id, ' = (x) => x')", "concat('router.get(\"/js/', doc_id % 40, '\", run_', doc_id, ')')"]
_SETTINGS = ["concat('token = \"', md5(concat('k', doc_id)), '\"')", "'[db]'", "concat('url = postgres://app:pw', doc_id, '@db/main')"]


def _content(clean: str) -> str:
    body = "coalesce({}, '')".format(clean)
    tail = lambda mark: f"concat('{mark} ', replace({body}, chr(10), concat(chr(10), '{mark} ')))"
    joined = lambda lines, end: "concat_ws(chr(10), " + ", ".join([*lines, end]) + ")"
    return (
        f"case kind when 'py' then {joined(_PYTHON, tail('#'))} when 'test' then {joined(_TEST, tail('#'))} when 'js' then {joined(_SCRIPT, tail('//'))} "
        f"when 'ini' then {joined(_SETTINGS, tail(';'))} else concat('# Notes', chr(10), {body}) end"
    )


_KIND = "case when doc_id % 9 = 0 then 'test' when doc_id % 11 = 0 then 'js' when doc_id % 13 = 0 then 'md' when doc_id % 17 = 0 then 'ini' else 'py' end"
_PATH = "case kind when 'py' then concat('app/pkg', doc_id % 20, '/mod_', doc_id, '.py') when 'test' then concat('tests/test_mod_', doc_id, '.py') when 'js' then concat('web/mod_', doc_id, '.js') when 'md' then concat('docs/note_', doc_id, '.md') else concat('conf/set_', doc_id, '.ini') end"
_LANGUAGE = "case kind when 'py' then 'python' when 'test' then 'python' when 'js' then 'javascript' when 'md' then 'markdown' else 'ini' end"
#: Control characters and line ends of which Python, Java and SQL think differently; all else of a text stays as it is.
CONTROL = "[\x01-\x09\x0b-\x1f\x7f\x85\u2028\u2029]"

FILES = (
    f"kinds as (select doc_id, text, {_KIND} as kind from documents), files as (select doc_id, {_PATH} as path, {_LANGUAGE} as language, "
    f"{_content(f"regexp_replace(text, '{CONTROL}', '?', 'g')")} as content from kinds), "
    "lines as (select path as file, language, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from files)"
)
#: Functions of the derived modules: each ends above its "# end".
SYMBOLS = (
    "defs as (select file, line as start_line, regexp_extract(text, '^def ([A-Za-z0-9_]+)', 1) as name, regexp_replace(text, ':$', '') as signature from lines where language = 'python' and starts_with(text, 'def ')), "
    "symbols as (select d.file, name, start_line, min(e.line) - 1 as end_line, signature from defs d join lines e on d.file = e.file and e.text = '# end' and e.line > start_line group by all), "
    "bodies as (select s.file, name, start_line, signature, line, text from symbols s join lines l on s.file = l.file and line between start_line and end_line)"
)
FOUND = "cast(line as int) as line, '{}' as category, '{}' as severity, {} as title, substring(trim({}), 1, 160) as snippet"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content) of the derived repository."""
    kinds = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_KIND).alias("kind"))
    return kinds.select(F.expr(_PATH).alias("path"), F.expr(_LANGUAGE).alias("language"), F.expr(_content(f"regexp_replace(text, '{CONTROL}', '?')")).alias("content"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, facts, symbols, routes)."""
    every = written(files(spark, sf_dir))
    facts = written(code.parse_python(every))
    return every, facts, code.symbols(facts), facts.where("tag = 'route'")


@query(f"with {FILES} select path, language, cast(length(content) - length(replace(content, chr(10), '')) + 1 as int) as n_lines, md5(content) as content_md5 from files")
def a1_repository_files(spark, sf_dir):
    """A1, H5: the files with their numbers of lines."""
    return files(spark, sf_dir).select("path", "language", (F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1).cast("int").alias("n_lines"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"with {FILES}, {SYMBOLS} select file, name, cast(start_line as int) as start_line, cast(end_line as int) as end_line, signature from symbols")
def n1_python_symbols(spark, sf_dir):
    """Functions that Python's own grammar finds."""
    return parsed(spark, sf_dir)[2].select("file", "name", "start_line", "end_line", "signature")


@query(
    rf"""with {FILES}, l as (select *, count(*) over (partition by file) as n from lines where language = 'javascript'),
f as (select file, line, n, coalesce(nullif(regexp_extract(text, '^export function ([A-Za-z0-9_]+)', 1), ''), nullif(regexp_extract(text, '^const ([A-Za-z0-9_]+) = \(', 1), '')) as name from l)
select file, case when starts_with(name, 'go_') then 'method' else 'function' end as kind, name, cast(line as int) as line, cast(least(line + 4, n) as int) as end_line from f where name is not null
union all select file, 'class', 'Box', line::int, line::int from l where text = 'class Box {{'
union all select file, 'import', regexp_extract(text, '(mod_[0-9]+)', 1), line::int, line::int from l where starts_with(text, 'import next')
union all select file, 'route', regexp_extract(text, '(run_[0-9]+)', 1), line::int, line::int from l where starts_with(text, 'router.get(')"""
)
def n2_script_symbols(spark, sf_dir):
    """Functions, classes, imports and routes of scripts, by patterns."""
    return code.parse_scripts(files(spark, sf_dir)).select("file", "kind", "name", F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"))


IMPORTS = (
    "imports as (select l.file, l.line, case when starts_with(text, 'from ') then split_part(text, ' ', 2) else split_part(text, ' ', 2) end as module, case when starts_with(text, 'from ') then split_part(text, ' ', 4) end as original from lines l "
    "where language = 'python' and (starts_with(text, 'from ') or starts_with(text, 'import '))), "
    "resolved as (select i.*, f.path as resolved from imports i left join files f on f.language = 'python' and replace(regexp_replace(f.path, '[.]py$', ''), '/', '.') = module)"
)


@query(f"with {FILES}, {IMPORTS} select file, module, resolved, resolved is null as external from resolved")
def c1_resolved_imports(spark, sf_dir):
    """Imports with the file each stands for; those of nothing in the repository are external."""
    every, facts, *_ = parsed(spark, sf_dir)
    return code.resolved_imports(every, facts).select("file", "module", "resolved", F.col("resolved").isNull().alias("external"))


@query(f"with {FILES}, {IMPORTS} select distinct file as src, resolved as dst from resolved where resolved is not null and file <> resolved")
def c3_import_edges(spark, sf_dir):
    """Edges between files."""
    every, facts, *_ = parsed(spark, sf_dir)
    return code.file_edges(every, facts)


CALLS = (
    f"{IMPORTS}, made as (select b.file, b.name as caller, unnest(regexp_extract_all(text, '(load_[0-9]+|helper_[0-9]+)[(]', 1)) as text from bodies b where line > start_line), "
    "one as (select name, min(file) as file from symbols group by name having count(*) = 1), "
    "edges as (select distinct m.file as caller_file, caller, coalesce(s.file, i.file, o.file) as callee_file, m.text as callee from made m left join symbols s on s.file = m.file and s.name = m.text "
    "left join (select r.file as caller_file, x.file, x.name from resolved r join symbols x on x.file = r.resolved and x.name = r.original) i on i.caller_file = m.file and i.name = m.text "
    "left join one o on o.name = m.text where coalesce(s.file, i.file, o.file) is not null)"
)


@query(f"with {FILES}, {SYMBOLS}, {CALLS} select * from edges")
def c5_call_resolution(spark, sf_dir):
    """Calls resolved by the cascade."""
    every, facts, *_ = parsed(spark, sf_dir)
    return code.call_edges(every, facts)


def _lines_with(category: str, severity: str, title: str) -> str:
    return f"with {FILES} select file, {FOUND.format(category, severity, quoted(title), 'text')} from lines where "


_BRACES = "regexp_extract_all(text, '[{]([A-Za-z0-9_]+)[}]', 1)"
_SQL_RULE = (
    f"case when len({_BRACES}) > 0 then not list_bool_and(list_transform({_BRACES}, lambda n: n = upper(n) and regexp_matches(n, '[A-Z]'))) and ({matches('text', detect.SQL_BUILD)} or {matches('text', detect.SQL_FORMATTED)}) "
    f"else {matches('text', detect.SQL_BUILD)} end"
)


@query(_lines_with("sql_injection", "HIGH", "SQL built via string interpolation (injection risk)") + _SQL_RULE)
def k2_sql_injection(spark, sf_dir):
    """K2, B7."""
    return detect.sql_injection(files(spark, sf_dir), None, None).drop("rationale")


@query(_lines_with("swallowed_error", "MEDIUM", "Broad except swallows the error") + matches("text", detect.SWALLOWED))
def k3_swallowed_errors(spark, sf_dir):
    return detect.swallowed_errors(files(spark, sf_dir), None, None).drop("rationale")


@query(_lines_with("dangerous_call", "HIGH", "Dangerous call (eval/exec/shell)") + matches("text", detect.DANGEROUS))
def k4_dangerous_calls(spark, sf_dir):
    return detect.dangerous_calls(files(spark, sf_dir), None, None).drop("rationale")


_RULE = f"case when {matches('text', detect.MUTABLE_DEFAULT)} then 1 when {matches('text', detect.EQUALS_NONE)} then 2 when {matches('text', detect.WEAK_HASH)} and secret then 3 when {matches('text', detect.TODO)} then 4 end"


@query(
    f"with {FILES}, p as (select path as file, contains(lower(content), 'password') as secret from files), r as (select lines.*, {_RULE} as rule from lines join p using (file)) "
    "select file, cast(line as int) as line, " + ", ".join(f"[{', '.join(quoted(r[k]) for r in detect.QUALITY)}][rule] as {n}" for k, n in enumerate(("category", "severity", "title"))) + ", substring(trim(text), 1, 160) as snippet from r where rule is not null"
)
def k5_code_quality(spark, sf_dir):
    """K5: the first rule that fits a line."""
    return detect.quality(files(spark, sf_dir), None, None).drop("rationale")


_BODY = f"with {FILES}, {SYMBOLS}"


@query(
    rf"""{_BODY}, given as (select file, name as symbol, start_line, line as given_at, regexp_extract(text, '^\s*([A-Za-z0-9_]+)\s*=', 1) as v from bodies where {matches('text', detect.MAY_BE_NONE)}),
later as (select g.file, symbol, g.start_line, given_at, v, line, text, case when regexp_matches(text, 'if[ \t]+(not[ \t]+)?' || v || '([^A-Za-z0-9_]|$)|' || v || '[ \t]+is[ \t]+(not[ \t]+)?None') then 0
  when regexp_matches(text, '(^|[^A-Za-z0-9_])' || v || '(\[[''"A-Za-z0-9_]|[.][A-Za-z0-9_])') then 1 end as event from given g join bodies b on b.file = g.file and b.start_line = g.start_line and line > given_at),
f as (select file, symbol, v, given_at, arg_min(event, line) as event, arg_min(text, line) as text, min(line) as line from later where event is not null group by all)
select file, {FOUND.format("unhandled_none", "HIGH", "concat('Possible None dereference: `', v, '` is used without a None check')", "text")} from f where event = 1"""
)
def k1_none_dereference(spark, sf_dir):
    """K1, E9."""
    return detect.none_dereference(*parsed(spark, sf_dir)[0:3:2], None).drop("rationale")


ROUTES = "routes as (select d.file, regexp_extract(d.text, '@router[.]([a-z]+)', 1) as verb, regexp_extract(d.text, '\"([^\"]+)\"', 1) as url, s.name, s.start_line, s.signature from lines d join symbols s on s.file = d.file and s.start_line = d.line + 1 where starts_with(d.text, '@router.'))"


@query(
    f"{_BODY}, {ROUTES} select r.file, cast(r.start_line as int) as line, 'missing_error_handling' as category, 'MEDIUM' as severity, concat(upper(verb), ' ', url, ': handler has no error handling') as title, r.signature as snippet "
    f"from routes r join bodies b on b.file = r.file and b.start_line = r.start_line group by r.file, r.start_line, verb, url, r.signature having not bool_or({matches('text', detect.HANDLED)})"
)
def k6_missing_error_handling(spark, sf_dir):
    """K6, C9."""
    every, _, symbols, routes = parsed(spark, sf_dir)
    return detect.missing_error_handling(every, symbols, routes).drop("rationale")


@query(
    f"""{_BODY}, r as (select *, {matches('text', detect.LOOP)} as head from bodies), g as (select *, count(*) filter (head) over (partition by file, start_line order by line) as loop from r),
c as (select *, bool_or(not head and {matches('text', detect.LOOP_END)}) over (partition by file, start_line, loop order by line) as closed from g where loop > 0),
h as (select *, row_number() over (partition by file, start_line, loop order by line) as rn from c where not closed and {matches('text', detect.LOOP_QUERY)})
select file, {FOUND.format("n_plus_one", "MEDIUM", "'Query executed inside a loop (N+1 pattern)'", "text")} from h where rn = 1"""
)
def k7_queries_in_loops(spark, sf_dir):
    """K7, E7, E8."""
    return detect.queries_in_loops(*parsed(spark, sf_dir)[0:3:2], None).drop("rationale")


@query(
    f"""{_BODY}, rated as (select distinct file, start_line, signature, p from (select *, unnest(regexp_extract_all(signature, {quoted(detect.PARAMETER)}, 1)) as p from symbols) where {matches('p', detect.RATE)}),
u as (select r.file, r.start_line, r.signature, p, bool_or(regexp_matches(text, '(^|[^A-Za-z0-9_])if[^A-Za-z0-9_](.*[^A-Za-z0-9_])?' || p || '([^A-Za-z0-9_]|$)')) as guarded, bool_or(line > b.start_line and contains(text, p)) as used
  from rated r join bodies b on b.file = r.file and b.start_line = r.start_line group by all)
select file, cast(start_line as int) as line, 'missing_validation' as category, 'MEDIUM' as severity, concat('`', p, '` is used without range validation') as title, substring(signature, 1, 160) as snippet from u where used and not guarded"""
)
def k8_unvalidated_rates(spark, sf_dir):
    return detect.unvalidated_rates(*parsed(spark, sf_dir)[0:3:2], None).drop("rationale")


@query(
    f"""{_BODY}, {ROUTES}, b as (select r.*, text from routes r join bodies b on b.file = r.file and b.start_line = r.start_line),
have as (select distinct file, start_line, unnest(regexp_extract_all(text, {quoted(detect.FIELD)}, 2)) as field from b), good as (select distinct file, start_line, unnest(regexp_extract_all(text, {quoted(detect.QUOTED)}, 1)) as field from b where {matches('text', detect.VALIDATES)}),
bad as (select file, start_line, string_agg(field, ', ' order by field) as fields from (select * from have except select * from good) group by all)
select r.file, cast(r.start_line as int) as line, 'missing_input_validation' as category, 'MEDIUM' as severity, concat(upper(verb), ' ', url, ': field(s) used without validation: ', fields) as title, substring(signature, 1, 160) as snippet from routes r join bad using (file, start_line)"""
)
def k9_missing_input_validation(spark, sf_dir):
    """K9, G3."""
    every, _, symbols, routes = parsed(spark, sf_dir)
    return detect.missing_input_validation(every, symbols, routes).drop("rationale")


@query(f"{_BODY} select file, {FOUND.format('dead_store', 'MEDIUM', quoted('`spent` is computed but never used'), 'text')} from bodies where trim(text) = 'spent += item'")
def k10_dead_stores(spark, sf_dir):
    """K10, N4."""
    return detect.stores_never_read(files(spark, sf_dir), None, None).drop("rationale")


@query("select category, sum(n)::bigint as n, min(severity) as severity from (" + " union all ".join(f"(select category, severity, 1 as n from ({SQL[k]}))" for k in sorted(SQL) if k.startswith("k")) + ") group by category")
def k16_all_checks(spark, sf_dir):
    """The registry of checks, by category."""
    every, _, symbols, routes = parsed(spark, sf_dir)
    return detect.run_checks(every, symbols, routes).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"))
