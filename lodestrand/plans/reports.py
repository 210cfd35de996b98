"""Investigations and search answers over the repository derived from ``documents``, for questions of every 20th document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import answer as A
from lodestrand.operators import chunks as C
from lodestrand.operators import code, detect
from lodestrand.operators import investigate as I
from lodestrand.operators import navigate as N
from lodestrand.operators import planner as P
from lodestrand.operators import rules as K
from lodestrand.operators.shared import written
from lodestrand.plans import answers, navigation, repository
from lodestrand.plans.repository import CALLS, FILES, IMPORTS, ROUTES, SYMBOLS, matches, parsed, quoted
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}
REPO = f"with recursive {FILES}, {SYMBOLS}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A route with a status, a route by a path with a slash at its end, or no route but words of security.
_COMPLAINT = (
    "case when doc_id % 60 = 0 then concat('why does POST /items/', doc_id % 40, ' return HTTP 404 instead of bound parameters, could the error handling be wrong') "
    "when doc_id % 60 = 20 then concat('Why might /items/', doc_id % 40, '/ fail with a negative rate or a None total in load_') else concat('why is load_', doc_id, ' broken, was the password or a token leak the reason') end"
)
_ROUTED = "doc_id % 60 in (0, 20)"


def _rationale(category: str, *found: str) -> str:
    import re

    parts = re.split(r"[{]([0-9])[}]", detect.RATIONALES[category])
    return "concat(" + ", ".join(found[int(x)] if i % 2 else quoted(x) for i, x in enumerate(parts) if x) + ")"


_PLAIN = ("k2_sql_injection", "k3_swallowed_errors", "k4_dangerous_calls", "k5_code_quality", "k6_missing_error_handling", "k7_queries_in_loops", "k9_missing_input_validation")
_SAID = "case category " + " ".join(f"when '{c}' then {quoted(r)}" for c, r in detect.RATIONALES.items() if "{0}" not in r) + " end"
_TITLED = "regexp_extract(title, '`([^`]+)`', 1)"
FINDINGS = (
    "given as (select file, start_line, line as given_at, regexp_extract(text, '^\\s*([A-Za-z0-9_]+)\\s*=', 1) as v, substring(trim(regexp_extract(text, " + quoted(detect.MAY_BE_NONE) + f", 2)), 1, 100) as by_ from bodies where {matches('text', detect.MAY_BE_NONE)}), "
    "noned as (select k.*, arg_max(by_, given_at) as by_, max(given_at) as given_at from (" + repository.SQL["k1_none_dereference"] + f") k join given g on g.file = k.file and g.v = {_TITLED} and g.given_at < k.line join symbols s on s.file = k.file and s.start_line = g.start_line and k.line between s.start_line and s.end_line group by all), "
    "found as (select file, line, category, severity, title, " + _SAID + " as rationale from (" + " union all ".join(f"(select * from ({repository.SQL[k]}))" for k in _PLAIN) + ") "
    f"union all select file, line, category, severity, title, {_rationale('unhandled_none', _TITLED, 'by_', 'given_at', 'line')} from noned "
    f"union all select file, line, category, severity, title, {_rationale('missing_validation', _TITLED)} from ({repository.SQL['k8_unvalidated_rates']}) "
    f"union all select k.file, k.line, category, severity, title, {_rationale('dead_store', _TITLED, 'b.name', quoted(''))} from ({repository.SQL['k10_dead_stores']}) k join bodies b on b.file = k.file and b.line = k.line)"
)
_BEFORE, _AFTER = I.REFERENCED.split("{0}")
_FIRST_SECRET = "case " + " ".join(f"when regexp_matches(text, {quoted(p)}) then '{k}'" for k, _, p in K.SECRETS) + " end"
INVESTIGATED = f"""{REPO}, {CALLS}, {ROUTES}, asked as (select doc_id as query_id, {_COMPLAINT} as question, case when {_ROUTED} then concat('/items/', doc_id % 40) end as hint, case when doc_id % 60 = 0 then '404' end as status from documents where doc_id % 20 = 0),
routed as (select query_id, arg_min(file, (file, start_line)) as file, arg_min(name, (file, start_line)) as handler, hint as path from asked join routes on url = hint group by query_id, hint),
l0 as (select distinct concat(file, ' ', handler) as trace, file, handler as symbol, 0 as depth, 0::bigint as ord from routed), s0 as (select * from l0){navigation._LEVELS},
hops as (select trace, (row_number() over (partition by trace order by depth, ord) - 1)::int as ord, depth, s.file, symbol, coalesce(start_line, 0)::int as line from s5 s left join symbols y on y.file = s.file and y.name = s.symbol),
hits as ({navigation.search_sql(_COMPLAINT, "null", 6)}),
nearest as (select query_id, split_part(chunk, ' ', -2) as file, min(rank) as ord from hits where query_id not in (select query_id from routed) group by all),
near as (select * from nearest qualify row_number() over (partition by query_id order by ord, file) <= 5),
came as (select query_id, h.file, min(h.ord) as ord, true as routed from routed r join hops h on h.trace = concat(r.file, ' ', handler) group by all union all select query_id, file, ord, false from near),
{FINDINGS},
places as (select * from (values {', '.join(f"('{c}', {i})" for i, c in enumerate(I.ALONG))}) as t(category, place)),
refs as (select url, file as place_at, min(line) as line from lines, (select distinct path as url from routed) where contains(text, '"' || url || '"') or contains(text, '''' || url || '''') group by all),
secrets as (select file, line, kind from (select *, {_FIRST_SECRET} as kind from lines) where kind is not null order by file, line limit 4),
every as (
  select c.query_id, f.*, coalesce(place, {len(I.ALONG)}) as place from came c join asked a using (query_id) join found f using (file) left join places p using (category) where not c.routed or (place is not null and not (category in ('unhandled_none', 'missing_error_handling') and status is not null and status <> '500'))
  union all select query_id, place_at, line, 'path_reference', 'LOW', concat('`', url, '` is referenced in ', place_at), concat({quoted(_BEFORE)}, place_at, {quoted(_AFTER)}), {len(I.ALONG) + 1} from routed join refs on url = path where place_at <> routed.file
  union all select query_id, file, line, 'exposed_secret', 'HIGH', concat(replace(kind, '_', ' '), ' (', kind, ')'), {quoted(I.EXPOSED)}, {len(I.ALONG) + 1} from asked, secrets where query_id not in (select query_id from routed) and {matches('question', I.SECURITY)}),
once as (select * from every qualify row_number() over (partition by query_id, category, file, line order by place, title) = 1),
scored as (select o.*, len(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z_./]{{3,}}')), lambda w: w not in ({', '.join(map(quoted, I.STOP))}) and contains(lower(concat_ws(' ', title, rationale, file)), w)))::int as relevance from once o join asked using (query_id)),
ranked as (select *, row_number() over (partition by query_id order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, relevance desc, file, line, place, title)::int as rank from scored)"""


def _investigated(spark, sf_dir):
    every, facts, symbols, routes = parsed(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.expr(_COMPLAINT).alias("question"))
    calls, imports = written(code.call_edges(every, facts)), code.resolved_imports(every, facts)
    rows = written(navigation.chunks_of(every, facts, symbols, routes).withColumn("chunk", F.concat_ws(" ", "id", "file", "start_line")))
    bare = asked.where(~F.col("question").rlike("/items/"))
    none = spark.createDataFrame([], "query_id long, file string, handler string")
    hits = C.hybrid_search(rows, bare.select("query_id", F.col("question").alias("text")), none, 6).join(rows.select("chunk", "file"), "chunk").select("query_id", "file", "rank")
    secrets = K.scan(every, "path", "content", K.SECRETS).select(F.col("path").alias("file"), F.col("line_no").cast("int").alias("line"), F.col("category").alias("kind"), F.replace("category", F.lit("_"), F.lit(" ")).alias("title"))
    return I.investigate(asked, every, symbols, routes, calls, N.tests_of(every, symbols, imports), secrets, hits)


@query(f"{INVESTIGATED} select query_id, rank, file, line::int as line, category, severity, title, relevance from ranked where rank <= 8")
def o9_investigations(spark, sf_dir):
    """The eight most suspicious findings for each complaint."""
    return _investigated(spark, sf_dir)[0]


@query(
    f"""{INVESTIGATED}, tests as ({navigation.SQL["c11_tests_of_files"]}), chains as (select trace, string_agg(concat(depth, ' ', symbol, ' ', file, ':', line), chr(10) order by ord) as chain from hops where ord < 8 group by trace),
covered as (select query_id, string_agg(test, ' ' order by test) as tests from (select distinct query_id, test from came join tests on path = file where (query_id, test) not in (select (query_id, file) from came)) group by query_id)
select a.query_id, case when r.file is not null then 'POST' end as verb, r.path, status, coalesce(chain, '') as chain, coalesce((select string_agg(file, ' ' order by ord, file) from came c where c.query_id = a.query_id), '') as files, coalesce(tests, '') as tests,
  (select count(*) from ranked k where k.query_id = a.query_id) as n_findings from asked a left join routed r using (query_id) left join chains on trace = concat(r.file, ' ', handler) left join covered using (query_id)"""
)
def o9_reports(spark, sf_dir):
    """Route, call chain, files and tests of each complaint."""
    return _investigated(spark, sf_dir)[1]


#: Where something is and which tests cover it, who calls a function, what imports a file.
_ASK = (
    "case when doc_id % 60 = 0 then concat('where is load_', doc_id, ' created in mod ', doc_id, ' and which tests for it exist') "
    "when doc_id % 60 = 20 then concat('who calls load_', cast(floor(doc_id / 3) as bigint) + 1, ' in the code') else concat('which files import app/pkg', doc_id % 20, '/mod_', doc_id, '.py') end"
)


@query(
    f"""{navigation.scored_sql(_ASK, "null", 8)}, {CALLS.removeprefix(IMPORTS + ', ')}, tests as ({navigation.SQL["c11_tests_of_files"]}),
asked as (select doc_id as query_id, {_ASK} as question from documents where doc_id % 20 = 0),
meant as (select query_id, arg_min(s.file, (s.file, s.start_line)) as of_, s.name from asked join symbols s on s.name = regexp_extract(question, {quoted(A.CALLED)}, 1) where {matches('question', A.DEPENDS)} group by query_id, s.name),
called as (select query_id, 0 as part, row_number() over (partition by query_id order by caller_file, caller) as ord, caller_file as file, s.start_line, s.start_line + 2 as end_line, caller as symbol, concat('calls ', m.name, ' (', of_, ')') as reason
  from meant m join edges e on e.callee_file = of_ and e.callee = m.name join symbols s on s.file = caller_file and s.name = caller),
mentions as (select query_id, unnest(regexp_extract_all(question, {quoted(A.MENTION)}, 1)) as mention, generate_subscripts(regexp_extract_all(question, {quoted(A.MENTION)}, 1), 1) as m from asked where {matches('question', A.DEPENDS)} and query_id not in (select query_id from meant)),
targets as (select query_id, arg_min(path, (m, path <> mention)) as target, arg_min(mention, (m, path <> mention)) as mention from mentions join files on path in (mention, mention || '.py', replace(mention, '.', '/') || '.py') group by query_id),
importing as (select query_id, target, mention, src as file, row_number() over (partition by query_id order by src) as ord from targets join edges_f on dst = target),
said as (select i.query_id, i.file, i.ord, i.target, min(l.line) as line, arg_min(l.text, l.line) as text from importing i join lines l on l.file = i.file and contains(l.text, 'import') and (contains(l.text, mention) or contains(l.text, replace(split_part(mention, '/', -1), '.py', ''))) group by all),
imported as (select query_id, 0 as part, ord, file, line as start_line, line as end_line, null::varchar as symbol, concat('imports ', target, ' (', substring(regexp_extract(text, '(import[ ]+.*)', 1), 1, 80), ')') as reason from said),
t as (select *, row_number() over (partition by query_id order by score desc, chunk)::int as rank from r where score > 0.02),
why as (select t.query_id, t.rank, g.file, g.start_line, g.end_line, g.symbol, coalesce(nullif(concat_ws('; ', case when kw >= 0.25 then 'strong term overlap with the question' when kw > 0.05 then 'partial term overlap' end, case when vec >= 0.35 then 'high semantic similarity' when vec > 0.15 then 'semantic similarity' end,
  case t.kind when 'route' then 'HTTP endpoint definition' when 'file' then 'module structure overview' end), ''), 'retrieved from the repository index') as reason from t join g using (chunk) where rank <= 8 and not contains(g.file, 'test')),
single as (select * from why qualify row_number() over (partition by query_id, file order by rank) = 1), best as (select *, row_number() over (partition by query_id order by rank) as cite from single qualify row_number() over (partition by query_id order by rank) <= 5),
turns as (select * from (select *, row_number() over (partition by callee_file, callee order by caller_file, caller) as turn from edges) where turn <= 2),
new as (select b.query_id, cite, turn, caller_file, caller, callee, callee_file, s.start_line as begins, s.end_line as ends from best b join turns e on e.callee_file = b.file and e.callee = b.symbol join symbols s on s.file = caller_file and s.name = caller
  where not starts_with(b.symbol, 'test_') and not contains(caller_file, 'test') and not exists (select 1 from best x where x.query_id = b.query_id and x.file = caller_file)),
fresh as (select * from new qualify row_number() over (partition by query_id, caller_file order by cite, turn) = 1),
added as (select * from (select *, count(*) over (partition by query_id order by cite range between unbounded preceding and 1 preceding) as before_ from fresh) where before_ < 2),
covering as (select a.query_id, b.file as path, test, row_number() over (partition by a.query_id order by test) as turn from asked a join best b on b.query_id = a.query_id and cite = 1 join tests on tests.path = b.file where {matches('question', A.TESTED)}),
every as (
  select * from called where ord <= 6 union all select * from imported where ord <= 6 union all select query_id, 1, cite, file, start_line, end_line, symbol, reason from best
  union all select query_id, 2, cite * 10 + turn, caller_file, begins, least(ends, begins + 12), caller, concat('calls ', callee, ' (', callee_file, ') — part of the execution flow') from added
  union all select query_id, 3, turn, test, 1, least(10, length(content) - length(replace(content, chr(10), '')) + 1), null, concat('test file covering ', covering.path) from covering join files on files.path = test where turn <= 2)
select * from (select query_id, row_number() over (partition by query_id order by part, ord)::int as rank, file, start_line::int as start_line, end_line::int as end_line, symbol, reason from every) where rank <= 8"""
)
def o8_search_answers(spark, sf_dir):
    """Citations that answer a question, from the graph and from retrieval."""
    every, facts, symbols, _ = parsed(spark, sf_dir)
    rows, top, _ = navigation.best_chunks(spark, sf_dir, _ASK, "null", 8)
    top = top.select("query_id", "chunk", "kind", "vec", "kw", "rank").withColumn("reason", C.reason(F.col("kind"), F.col("vec"), F.col("kw"))).drop("kind")
    hits = top.join(rows.select("chunk", "file", "start_line", "end_line", "symbol"), "chunk")
    asked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.expr(_ASK).alias("question"))
    calls, edges = written(code.call_edges(every, facts)), written(code.file_edges(every, facts))
    return A.search_answers(asked, written(hits), every, symbols, calls, edges, N.tests_of(every, symbols, code.resolved_imports(every, facts)))


@query(
    f"""{REPO}, told as ({{}}), lang as (select string_agg(concat(value, ' (', n, ' files)'), ', ' order by rank) as x from told where aspect = 'language' and rank <= 5), fw as (select string_agg(value, ', ' order by rank) as x from told where aspect = 'framework'),
dbs as (select string_agg(value, ', ' order by rank) as x from told where aspect = 'database'), tests_ as (select string_agg(path, ', ' order by path) as x from (select path from files where starts_with(path, 'tests/') order by path limit 4)),
size_ as (select max(n) filter (value = 'files') as f, max(n) filter (value = 'lines') as l from told where aspect = 'size'), known as (select count(*) as n from symbols), ways as (select count(*) as n from lines where starts_with(text, '@router.')),
t as (select unnest([concat('Languages: ', coalesce((select x from lang), 'n/a')), concat('Frameworks: ', coalesce((select x from fw), 'n/a')), concat('Database: ', coalesce((select x from dbs), 'n/a')), 'Main entry: (not detected)',
  'Authentication: (not found) ()', 'API: (not found) ()', 'Business logic: (not found) ()', 'Data access: (not found) ()', 'Models: (not found) ()', concat('Tests: ', coalesce((select x from tests_), '(none found)')), '',
  (select concat(f, ' files, ', format('{{:,}}', l), ' lines, ', known.n, ' symbols, ', ways.n, ' HTTP endpoints.') from size_, known, ways)]) as text, unnest(range(1, 13)) as line_no) select line_no::int as line_no, text from t""".replace("told as ({})", "told as (" + answers.SQL["k0_repository_summary"] + ")").replace("{:,}", "{:,}")
)
def o7_repository_report(spark, sf_dir):
    """The twelve lines about a repository."""
    every = repository.files(spark, sf_dir)
    facts = written(code.parse_python(every))
    return A.repository_report(every, code.symbols(facts), facts.where("tag = 'route'"))
