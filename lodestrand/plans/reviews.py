"""Queries over unified diffs that Spark derives from ``documents``, one change of a module each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import code, detect, diffs
from lodestrand.operators import navigate as N
from lodestrand.operators import review as V
from lodestrand.operators.rules import SECRETS
from lodestrand.plans.repository import CONTROL, FILES, SYMBOLS, matches, parsed, quoted
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DIFF = [
    "concat('diff --git a/app/pkg', doc_id % 20, '/mod_', doc_id, '.py')", "concat('--- a/app/pkg', doc_id % 20, '/mod_', doc_id, '.py')", "concat('+++ b/app/pkg', doc_id % 20, '/mod_', doc_id, '.py')", "concat('@@ -1,6 +', doc_id % 30 + 1, ',14 @@')", "' import os'",
    "concat('-def load_', doc_id, '(items, other, extra=1):')", "case when doc_id % 4 = 0 then '-    user = Depends(get_current_user)' end", "concat('+def load_', doc_id, case when doc_id % 11 = 0 then '(items=[], other=None):' else '(items, other):' end)",
    "case when doc_id % 8 = 0 then '+    who = verify_token(other)' end", "concat('+    password = \"', md5(concat('p', doc_id)), '\"')", "case when doc_id % 5 = 0 then '+    token = os.environ[\"A\"] or \"0123456789abcdef\"' end", "'+    for row in items:'",
    "case when doc_id % 3 = 0 then '+        session.query(row)' end", "case when doc_id % 3 = 1 then '+    conn.execute(other)' end", "case when doc_id % 6 = 0 then '+        cursor.execute(f\"SELECT {row}\")' end", "case when doc_id % 7 = 0 then '+    except Exception:' end",
    "case when doc_id % 8 = 3 then '+    if row == None: eval(row)  # TODO' end", "'     return None'",
]
_WHOLE = "concat_ws(chr(10), " + ", ".join(_DIFF) + ", concat(' ', replace(regexp_replace(coalesce(text, ''), '" + CONTROL + "', '?'<flags>), chr(10), concat(chr(10), ' '))))"
ROWS = (
    f"diffs as (select doc_id as diff_id, {_WHOLE.replace('<flags>', ", 'g'")} as diff from documents), dl as (select diff_id, unnest(string_split(diff, chr(10))) as raw, generate_subscripts(string_split(diff, chr(10)), 1) - 1 as seq from diffs), "
    "dh as (select *, max(case when starts_with(raw, '+++ ') then substring(raw, 7) end) over (partition by diff_id) as path, max(case when starts_with(raw, '@@') then regexp_extract(raw, '[+]([0-9]+)', 1)::int end) over (partition by diff_id) as start from dl), "
    "dr as (select *, start + coalesce(sum(case when starts_with(raw, '-') then 0 else 1 end) over (partition by diff_id order by seq rows between unbounded preceding and 1 preceding), 0) as line from dh where seq > 3 and not starts_with(raw, '---')), "
    "rows as (select diff_id, path, raw[1] as op, cast(line as int) as line, substring(raw, 2) as text, seq from dr where raw[1] in ('+', '-'))"
)


def changes(spark, sf_dir):
    """(diff_id, diff)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.expr(_WHOLE.replace("<flags>", "")).alias("diff"))


@query(f"with {ROWS} select diff_id, path, op, line, text from rows")
def l1_diff_rows(spark, sf_dir):
    """Added and removed lines with their numbers."""
    return diffs.parse(changes(spark, sf_dir)).select("diff_id", "path", "op", "line", "text")


def _sql(category: str, severity: str, title: str, where: str, rows: str = "rows", snippet: str = "trim(text)") -> str:
    return f"select diff_id, path as file, cast(line as int) as line, '{category}' as category, '{severity}' as severity, {title} as title, substring({snippet}, 1, 160) as snippet from {rows} where {where}"


_BRACES = "regexp_extract_all(text, '[{]([A-Za-z0-9_]+)[}]', 1)"
_BUILDS = f"case when len({_BRACES}) > 0 then not list_bool_and(list_transform({_BRACES}, lambda n: n = upper(n) and regexp_matches(n, '[A-Z]'))) and ({matches('text', detect.SQL_BUILD)} or {matches('text', detect.SQL_FORMATTED)}) else {matches('text', detect.SQL_BUILD)} end"
_TESTS = (_BUILDS, matches("text", detect.DANGEROUS), f"({matches('text', detect.SWALLOWED)} or {matches('text', detect.BARE_HANDLER)})", matches("text", detect.MUTABLE_DEFAULT), matches("text", detect.TODO), matches("text", detect.EQUALS_NONE))
L2 = " union all ".join(_sql(c, s, quoted(t), f"op = '+' and {test}") for (c, s, t, _), test in zip(V.ADDED, _TESTS, strict=True))
_KIND = "case " + " ".join(f"when {matches('text', p)} then '{k}'" for k, _, p in SECRETS) + " end"
L3 = _sql("hardcoded_secret", "HIGH", "concat(kind, ' committed in the diff')", "kind is not null", f"(select *, {_KIND} as kind from rows where op = '+' and not contains(text, 'environ') and not contains(text, 'getenv'))", r"regexp_replace(text, '([A-Za-z0-9_/+-]{4})[A-Za-z0-9_/+-]{2,}', '\1***', 'g')")
_GONE, _BACK = f"op = '-' and {matches('text', V.AUTH)}", f"op = '+' and {matches('text', V.AUTH_AGAIN)}"
L4 = _sql("removed_auth", "HIGH", "'Authentication / token verification removed'", "gone and not back", f"(select diff_id, path, bool_or({_GONE}) as gone, bool_or({_BACK}) as back, arg_min(text, seq) filter ({_GONE}) as text, coalesce(arg_min(line, seq) filter (op = '+'), 1) as line from rows group by diff_id, path)")
L5 = _sql("breaking_change", "MEDIUM", "concat('Breaking change to load_', diff_id, '(): parameter(s) removed: extra')", "op = '+' and starts_with(text, 'def load_')")
_LOOPS = (
    f"(select * from (select *, row_number() over (partition by diff_id order by seq) as rn from (select *, bool_or(not head and trim(text) <> '' and length(text) - length(ltrim(text)) <= 4) over (partition by diff_id order by seq) as closed "
    f"from (select * from (select *, {matches('ltrim(text)', V.LOOP_HEAD)} as head from rows where op = '+') qualify bool_or(head) over (partition by diff_id order by seq))) where not closed and not head and {matches('text', V.QUERY)}) where rn = 1)"
)
L6 = _sql("n_plus_one", "MEDIUM", "'Query executed inside a loop (N+1 pattern)'", "true", _LOOPS)


@query(f"with {ROWS} {L2}")
def l2_added_lines(spark, sf_dir):
    """L2: every check that fits an added line."""
    return V.added_lines(diffs.parse(changes(spark, sf_dir)))


@query(f"with {ROWS} {L3}")
def l3_secret_lines(spark, sf_dir):
    """L3, C25, H8."""
    return V.secret_lines(diffs.parse(changes(spark, sf_dir)))


@query(f"with {ROWS} {L4}")
def l4_removed_auth(spark, sf_dir):
    return V.removed_auth(diffs.parse(changes(spark, sf_dir)))


@query(f"with {ROWS} {L5}")
def l5_breaking_changes(spark, sf_dir):
    """L5, C19."""
    return V.breaking_changes(diffs.parse(changes(spark, sf_dir)))


@query(f"with {ROWS} {L6}")
def l6_loop_queries(spark, sf_dir):
    """L6, E8."""
    return V.loop_queries(diffs.parse(changes(spark, sf_dir)))


_TESTED = "tested as (select distinct s.file as path from symbols s join files t on starts_with(t.path, 'tests/') and length(s.name) > 4 and contains(t.content, s.name) and s.file <> t.path union select distinct resolved from resolved where resolved is not null and starts_with(file, 'tests/'))"


def _imports() -> str:
    from lodestrand.plans.repository import IMPORTS

    return IMPORTS


L7 = _sql("missing_tests", "MEDIUM", "'No unit test for the changed code'", "path not in (select path from tested)", "(select diff_id, path, arg_min(line, seq) as line, substring(trim(arg_min(text, seq)), 1, 120) as text from rows where op = '+' group by diff_id, path)")


def _tests(spark, sf_dir):
    every, facts, symbols, _ = parsed(spark, sf_dir)
    return every, symbols, N.tests_of(every, symbols, code.resolved_imports(every, facts))


@query(f"with {FILES}, {SYMBOLS}, {_imports()}, {_TESTED}, {ROWS} {L7}")
def l7_missing_tests(spark, sf_dir):
    """L7, C12."""
    return V.missing_tests(diffs.parse(changes(spark, sf_dir)), _tests(spark, sf_dir)[2])


#: Functions of the derived modules are short, so here those of more than ten lines are long.
_LONG = 10
L8 = "select diff_id, s.file, cast(start_line as int) as line, 'maintainability' as category, 'LOW' as severity, concat(name, ' is ', end_line - start_line, ' lines long') as title, substring(trim(signature), 1, 160) as snippet from (select distinct diff_id, path from rows) r join symbols s on s.file = r.path where end_line - start_line > " + str(_LONG)


@query(f"with {FILES}, {SYMBOLS}, {ROWS} {L8}")
def l8_long_functions(spark, sf_dir):
    return V.long_functions(diffs.parse(changes(spark, sf_dir)), parsed(spark, sf_dir)[2], _LONG)


def _own() -> str:
    from lodestrand.plans.repository import SQL as K

    return f"own as ({K['k1_none_dereference']}), own2 as ({K['k2_sql_injection']}), own3 as ({K['k7_queries_in_loops']}), every_own as (select * from own union all select * from own2 union all select * from own3)"


L9 = "select distinct diff_id, o.file, o.line, category, severity, title, snippet from every_own o join rows r on r.path = o.file and op = '+' and abs(o.line - r.line) <= 5"


@query(f"with {_own()}, {ROWS} {L9}")
def l9_near_touched(spark, sf_dir):
    """Findings of the repository near added lines."""
    every, _, symbols, _ = parsed(spark, sf_dir)
    own = detect.run_checks(every, symbols, symbols, ["sql_injection", "unhandled_none", "n_plus_one"])
    return V.near_touched(diffs.parse(changes(spark, sf_dir)), own)


@query(
    f"with {FILES}, {SYMBOLS}, {_imports()}, {_TESTED}, {_own()}, {ROWS}, found as ({' union all '.join((L2, L3, L4, L5, L6, L7, L9))}), once as (select diff_id, category, file, line, title, min(severity) as severity, min(snippet) as snippet from found group by all), "
    "k as (select *, row_number() over (partition by diff_id order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, file, line, category, title)::int as rank from once) select *, rank <= 12 as cited from k"
)
def l10_diff_review(spark, sf_dir):
    """The whole review of each diff."""
    return V.review(changes(spark, sf_dir), *_tests(spark, sf_dir))
