"""Queries to the graph and the chunks of the repository derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import chunks as C
from lodestrand.operators import code
from lodestrand.operators import hybrid as H
from lodestrand.operators import navigate as N
from lodestrand.operators import retrieval as R
from lodestrand.operators.shared import written
from lodestrand.plans.repository import CALLS, FILES, IMPORTS, ROUTES, SYMBOLS, files, parsed
from lodestrand.plans.texts import TOKENS
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REPO = f"with {FILES}, {SYMBOLS}"
#: What is asked: names of functions, some in another case, by every 20th document.
_NAME = "case when doc_id % 40 = 0 then concat('LOAD_', doc_id) else concat('create_', doc_id) end"


@query(f"{REPO}, asked as (select distinct {_NAME} as name from documents where doc_id % 20 = 0) select a.name, file, s.name as qualified, cast(start_line as int) as start_line from asked a join symbols s on lower(a.name) = lower(s.name)")
def c8_find_symbol(spark, sf_dir):
    """Symbols by name, exactly or else in any case."""
    names = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.expr(_NAME).alias("name"))
    return N.find_symbols(parsed(spark, sf_dir)[2], names)


#: Hints of routes by every 20th document: a whole path, one with a slash at its end, or a part that several paths hold.
_HINT = "case when doc_id % 60 = 0 then concat('/items/', doc_id % 40, '/') when doc_id % 60 = 20 then concat('/items/', doc_id % 7, '9/more') else '/items/3' end"
_WANTED = "case when doc_id % 40 = 0 then 'post' else 'get' end"


@query(
    f"""{REPO}, {ROUTES}, asked as (select doc_id as hint_id, regexp_replace({_HINT}, '/+$', '') as hint, upper({_WANTED}) as wanted from documents where doc_id % 20 = 0),
p as (select distinct url from routes), m as (select distinct hint, url, url = hint as exact from asked, p where contains(url, hint) or contains(hint, url)),
b as (select *, bool_or(exact) over (partition by hint) as found from m),
r as (select hint_id, upper(verb) as verb, b.url as path, file, name as handler, row_number() over (partition by hint_id order by (upper(verb) = wanted) desc, case when exact then 0 else length(b.url) end desc, file, start_line) as rn
  from asked join b on b.hint = asked.hint and (exact or not found) join routes r on r.url = b.url)
select hint_id, verb, path, file, handler from r where rn = 1"""
)
def c10_find_route(spark, sf_dir):
    """The route that a hint means."""
    hints = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("hint_id"), F.expr(_HINT).alias("hint"), F.expr(_WANTED).alias("verb"))
    routes = code.parse_python(files(spark, sf_dir)).where("tag = 'route'").select("file", "name", "kind", "path", "start_line")
    return N.find_routes(written(routes), hints)


@query(
    f"""{REPO}, {IMPORTS}, t as (select * from files where starts_with(path, 'tests/')), by_import as (select resolved as path, file as test from resolved where resolved is not null and starts_with(file, 'tests/')),
runs as (select path as test, unnest(regexp_extract_all(content, '[A-Za-z0-9_]{{5,}}')) as run from t), said as (select s.file as path, test from runs join symbols s on length(s.name) > 4 and contains(run, s.name))
select distinct path, test from (select * from by_import union all select * from said) where path <> test"""
)
def c11_tests_of_files(spark, sf_dir):
    """Tests that import a file or name one of its symbols."""
    every, facts, symbols, _ = parsed(spark, sf_dir)
    return N.tests_of(every, symbols, code.resolved_imports(every, facts))


EDGES = "edges_f as (select distinct file as src, resolved as dst from resolved where resolved is not null and file <> resolved)"


@query(
    f"{REPO}, {IMPORTS}, {EDGES}, b as (select src as path, 'dependency' as direction, dst as other from edges_f union all select dst, 'dependent', src from edges_f), "
    "r as (select *, row_number() over (partition by path, direction order by other)::int as rank from b) select * from r where rank <= 6"
)
def c26_direct_neighbours(spark, sf_dir):
    """Dependencies and dependents of each file."""
    every, facts, *_ = parsed(spark, sf_dir)
    return N.direct_neighbours(code.file_edges(every, facts))


@query(f"{REPO}, {CALLS}, r as (select *, row_number() over (partition by callee_file, callee order by caller_file, caller)::int as rank from edges where not starts_with(caller_file, 'tests/')) select * from r where rank <= 2")
def c17_callers(spark, sf_dir):
    """Callers of each symbol."""
    every, facts, *_ = parsed(spark, sf_dir)
    return N.callers_of(code.call_edges(every, facts))


_LEVELS = "".join(
    f", e{d} as (select trace, e.callee_file as file, e.callee as symbol, min(ord) as parent from l{d - 1} l join edges e on e.caller_file = l.file and e.caller = l.symbol group by all), "
    f"l{d} as (select trace, file, symbol, {d} as depth, row_number() over (partition by trace order by parent, file, symbol) as ord from e{d} where not exists (select 1 from s{d - 1} s where s.trace = e{d}.trace and s.file = e{d}.file and s.symbol = e{d}.symbol)), "
    f"s{d} as (select * from s{d - 1} union all select * from l{d})"
    for d in range(1, 6)
)


@query(
    f"""{REPO}, {CALLS}, {ROUTES}, l0 as (select concat(r.file, ' ', url) as trace, r.file, r.name as symbol, 0 as depth, 0 as ord from routes r), s0 as (select * from l0){_LEVELS}
select trace, (row_number() over (partition by trace order by depth, ord) - 1)::int as ord, depth, s.file, symbol, coalesce(start_line, 0)::int as line, coalesce(signature, '') as signature from s5 s left join symbols y on y.file = s.file and y.name = s.symbol"""
)
def i4_route_trace(spark, sf_dir):
    """I4: what each handler calls, to depth 5, in the order of the walk."""
    every, facts, symbols, routes = parsed(spark, sf_dir)
    starts = routes.select(F.concat_ws(" ", "file", "path").alias("trace"), "file", F.col("name").alias("handler"))
    return N.trace_routes(starts, written(code.call_edges(every, facts)), symbols)


@query(f"{REPO}, n as (select file, string_agg('function ' || name, ', ' order by start_line) as said from symbols group by file) select path, case when said is null then path else concat(path, ': ', said) end as summary from files left join n on n.file = path")
def i9_file_summaries(spark, sf_dir):
    every, _, symbols, _ = parsed(spark, sf_dir)
    return N.file_summaries(every, symbols)


_REDACT = "regexp_replace(regexp_replace({}, '[a-z][a-z0-9+]*://[^:/@ ]+:[^@/ ]+@', '***REDACTED***', 'g'), '(token|secret|password|passwd|api_key|apikey)[ ]*[=:][ ]*[\"''][^\"'' ]{{8,}}[\"'']', '***REDACTED***', 'g')"
CHUNKS = f"""{IMPORTS}, {EDGES}, {ROUTES},
body as (select file, start_line, string_agg(text, chr(10) order by line) filter (line <= start_line + 60) as body from bodies group by all),
deco as (select r.file, r.start_line, regexp_replace(regexp_replace(l.text, '^@', ''), '"', '''', 'g') as said from routes r join lines l on l.file = r.file and l.line = r.start_line - 1),
listed as (select file, string_agg(name, ', ' order by start_line) as said from symbols group by file), mods as (select file, string_agg(module, ', ' order by line) as said from imports group by file),
deps as (select src as file, string_agg(dst, ', ' order by dst) as said from edges_f group by src),
chunks as (
  select concat_ws(':', 'sym', s.file, s.name, s.start_line) as id, 'symbol' as kind, s.file, s.start_line, s.end_line, s.name as symbol,
    concat_ws(chr(10), concat('file: ', s.file), concat('function ', s.name), s.signature, 'decorators: ' || d.said, body) as text from symbols s join body b using (file, start_line) left join deco d using (file, start_line)
  union all select concat('file:', path), 'file', path, 1, least(length(content) - length(replace(content, chr(10), '')) + 1, 40), null,
    concat_ws(chr(10), concat('file: ', path, ' (', language, ')'), concat('symbols: ', coalesce(a.said, '(none)')), concat('imports: ', coalesce(m.said, '(none)')), concat('depends on: ', coalesce(e.said, '(none)')), '---', substring(content, 1, 2500))
    from files left join listed a on a.file = path left join mods m on m.file = path left join deps e on e.file = path where language in ('python', 'javascript')
  union all select concat_ws(':', 'route', upper(verb), url), 'route', r.file, r.start_line, r.start_line + 12, r.name,
    concat_ws(chr(10), concat('endpoint: ', upper(verb), ' ', url), concat('handler: ', r.name, ' ', r.signature), concat('file: ', r.file), (select string_agg(text, chr(10) order by line) from lines l where l.file = r.file and line between r.start_line and r.start_line + 14)) from routes r
  union all select concat('doc:', path), 'doc', path, 1, least(length(content) - length(replace(content, chr(10), '')) + 1, case language when 'ini' then 100 else 200 end), null,
    case language when 'ini' then concat('config: ', path, ' (redacted)', chr(10), substring({_REDACT.format("content")}, 1, 3000)) else concat('doc: ', path, chr(10), substring(content, 1, 4000)) end from files where language in ('markdown', 'ini'))"""


def repository_chunks(spark, sf_dir):
    return chunks_of(*parsed(spark, sf_dir))


def chunks_of(every, facts, symbols, routes):
    imports = code.resolved_imports(every, facts)
    return C.chunk(every, symbols, routes, imports.select("file", "line", "module"), code.file_edges(every, facts))


@query(f"{REPO}, {CHUNKS} select id, kind, file, start_line::int as start_line, end_line::int as end_line, symbol, md5(text) as text_md5 from chunks")
def j1_repository_chunks(spark, sf_dir):
    """The five producers of chunks."""
    rows = repository_chunks(spark, sf_dir)
    return rows.select("id", "kind", "file", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "symbol", F.md5(F.col("text").cast("binary")).alias("text_md5"))


BAG = """{0}w as (select {1}, unnest({2}) as word from {3}),
{0}c as (select {1}, word, count(*) as n from {0}w group by all),
{0}f as (select {1}, 'w:' || word as term, n from {0}c union all select {1}, 'g:' || substr('^' || word || '$', unnest(range(1, length(word) + 1)), 3), n from {0}c),
{0}b as (select {1}, term, sum(n)::bigint as n from {0}f group by all)"""


@query(f"with {BAG.format('d', 'doc_id', TOKENS.format('text'), 'documents')} select doc_id, count(*) as n_features, sum(n)::bigint as n_total, max(n) as n_most from db group by doc_id")
def j2_feature_bag(spark, sf_dir):
    """Words and trigrams in one bag."""
    return H.feature_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Questions by every 20th document.
_QUESTION = "concat('where is load_', doc_id, ' created or validated in mod ', doc_id, ' for POST /items/', doc_id % 40, case when doc_id % 60 = 0 then ' nowhereword' else '' end)"


def scored_sql(question: str, hint: str, k: int = 10) -> str:
    """CTEs up to r: scores of all chunks that count."""
    return f"""{REPO}, {CHUNKS}, g as (select *, concat_ws(' ', id, file, start_line) as chunk from chunks), q as (select doc_id as query_id, {question} as text, {hint} as hint from documents where doc_id % 20 = 0),
{BAG.format("d", "chunk", TOKENS.format("text"), "g")}, {BAG.format("a", "query_id", TOKENS.format("text"), "q")},
nd as (select count(*) as n_docs from g), w as (select term, ln((max(n_docs) + 1.0) / (count(*) + 1.0)) + 1.0 as idf from db, nd group by term),
dr as (select chunk, d.term, (1 + ln(n::double)) * idf as raw from db d join w using (term)), dn as (select chunk, sqrt(sum(raw * raw)) as norm from dr group by chunk),
qr as (select query_id, b.term, (1 + ln(n::double)) * coalesce(idf, ln(n_docs + 1.0) + 1.0) as raw from ab b cross join nd left join w on w.term = b.term), qn as (select query_id, sqrt(sum(raw * raw)) as norm from qr group by query_id),
dots as (select query_id, chunk, round(sum(qr.raw / qn.norm * (dr.raw / dn.norm)), 6) as vec from qr join qn using (query_id) join dr on dr.term = qr.term join dn using (chunk) group by all),
dense as (select * from dots qualify row_number() over (partition by query_id order by vec desc, chunk) <= {max(3 * k, 24)}),
qw as (select distinct query_id, word from ac), hw as (select distinct chunk, word from dc), qs as (select query_id, count(*) as q from qw group by query_id),
shared as (select query_id, chunk, count(*) as shared from qw join hw using (word) group by all),
pathed as (select query_id, chunk, count(*) as n_path from qw join g on length(word) > 2 and contains(lower(file), word) group by all),
verbs as (select query_id, unnest(['create', 'encode', 'build', 'make', 'new', 'generate']) as v from qw where word = 'created' union select query_id, unnest(['validate', 'verify', 'check']) from qw where word = 'validated'),
sym as (select query_id, chunk, max(sym) as sym from (select query_id, chunk, 0.35 as sym from qw join g on word = lower(symbol) union all select query_id, chunk, 0.3 from verbs join g on starts_with(lower(symbol), v || '_') or lower(symbol) = v) group by all),
hinted as (select query_id, arg_min(r.file, (r.file, r.start_line)) as file, arg_min(r.name, (r.file, r.start_line)) as handler from q join routes r on r.url = q.hint group by query_id),
boost as (select distinct query_id, chunk, 0.6 as boost from hinted h join g on g.kind = 'route' and g.file = h.file and g.symbol = h.handler),
pairs as (select query_id, chunk from dense union select query_id, chunk from shared union select query_id, chunk from pathed union select query_id, chunk from sym union select query_id, chunk from boost),
s as (select p.query_id, p.chunk, g.kind, coalesce(vec, 0) as vec, coalesce(shared / (sqrt(q::double) + 1e-9), 0) as kw, n_path, sym, boost from pairs p join g using (chunk) left join dense using (query_id, chunk) left join shared using (query_id, chunk)
  left join pathed using (query_id, chunk) left join sym using (query_id, chunk) left join boost using (query_id, chunk) left join qs using (query_id)),
r as (select *, round((0.55 * vec + 0.45 * least(kw, 1.0) + 0.08::double * coalesce(n_path, 0) + coalesce(sym, 0)::double + coalesce(boost, 0)::double) * case kind when 'file' then 0.85::double else 1.0 end, 6) as score from s)"""


def search_sql(question: str, hint: str, k: int = 10) -> str:
    return scored_sql(question, hint, k) + f""",
t as (select *, row_number() over (partition by query_id order by score desc, chunk)::int as rank from r where score > 0.02)
select query_id, chunk, score, rank, coalesce(nullif(concat_ws('; ', case when kw >= 0.25 then 'strong term overlap with the question' when kw > 0.05 then 'partial term overlap' end, case when vec >= 0.35 then 'high semantic similarity' when vec > 0.15 then 'semantic similarity' end,
  case kind when 'route' then 'HTTP endpoint definition' when 'file' then 'module structure overview' end), ''), 'retrieved from the repository index') as reason from t where rank <= {k}"""


@query(search_sql(_QUESTION, "concat('/items/', doc_id % 40)"))
def j8_code_search(spark, sf_dir):
    """Hybrid scores of chunks with boosts of paths, symbols, verbs and routes."""
    best = best_chunks(spark, sf_dir, _QUESTION, "concat('/items/', doc_id % 40)")[1]
    return best.select("query_id", "chunk", "score", "rank", C.reason(F.col("kind"), F.col("vec"), F.col("kw")).alias("reason"))


def best_chunks(spark, sf_dir, question: str, hint: str, k: int = 10, kinds: tuple[str, ...] = (), most: int | None = None):
    """(chunks, which are written, the best of them for the question that every 20th document asks, a function that scores pairs)."""
    some = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.expr(question).alias("text"), F.expr(hint).cast("string").alias("hint"))
    hints = some.where("hint is not null").select(F.col("query_id").alias("hint_id"), "hint", F.lit(None).cast("string").alias("verb"))
    every, facts, symbols, routes = parsed(spark, sf_dir)
    routed = N.find_routes(routes, hints).select(F.col("hint_id").alias("query_id"), "file", "handler")
    rows = written(chunks_of(every, facts, symbols, routes).withColumn("chunk", F.concat_ws(" ", "id", "file", "start_line")))
    return rows, *C.best_chunks(rows, some.select("query_id", "text"), routed, k, kinds, most)


@query(
    scored_sql(_QUESTION, "concat('/items/', doc_id % 40)")
    + ", picked as (select r.query_id, r.chunk, score, row_number() over (partition by r.query_id order by score desc, r.chunk)::int as rank from r where score > 0.02 and kind = 'symbol') select query_id, chunk, score, rank from picked where rank <= 5"
)
def b4_symbol_search(spark, sf_dir):
    """The search confined to chunks of one kind."""
    return best_chunks(spark, sf_dir, _QUESTION, "concat('/items/', doc_id % 40)", kinds=("symbol",), most=5)[1].select("query_id", "chunk", "score", "rank")


#: crc32 of a text ``term``, from a table of 256 values made by its rule.
CRC = """bits(b, k, c) as (select b, 0, b::bigint from range(256) as t(b) union all select b, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8),
tab as (select list(c order by b) as tab from bits where k = 8)"""
_HASHED = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(term, ''), lambda s: ascii(s)::bigint)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])))"
BUCKETED = f"""with recursive {CRC}, {BAG.format('d', 'doc_id', TOKENS.format('text'), 'documents')}, {BAG.format('a', 'item_id', TOKENS.format('text'), 'benchmark')},
terms as (select term from db union select term from ab), hashed as (select term, ({_HASHED} % {R.WIDTH})::int as bucket from terms, tab),
dt as (select doc_id, bucket, sum(1 + ln(n::double)) as tf from db join hashed using (term) group by all), at_ as (select item_id as query_id, bucket, sum(1 + ln(n::double)) as tf from ab join hashed using (term) group by all),
nd as (select greatest(count(*), 1) as n_docs from documents), ib as (select bucket, ln((max(n_docs) + 1.0) / (count(*) + 1.0)) + 1.0 as idf from dt, nd group by bucket),
dr as (select doc_id, bucket, tf * idf as raw from dt join ib using (bucket)), dn as (select doc_id, sqrt(sum(raw * raw)) as norm, count(*) as n_buckets from dr group by doc_id),
ar as (select query_id, a.bucket, tf * coalesce(idf, ln(n_docs + 1.0) + 1.0) as raw from at_ a cross join nd left join ib on ib.bucket = a.bucket), an as (select query_id, sqrt(sum(raw * raw)) as norm from ar group by query_id)"""


def _buckets(spark, sf_dir):
    """(vectors of documents, a function that weights other texts alike)."""
    return H.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"{BUCKETED} select doc_id, n_buckets, round(norm, 5) as norm from dn")
def d5_bucket_vectors(spark, sf_dir):
    """Documents as hashed vectors with colliding features added."""
    return _buckets(spark, sf_dir)[0].select("doc_id", F.size("buckets").cast("long").alias("n_buckets"), F.round("norm", 5).alias("norm"))


@query(f"{BUCKETED}, dots as (select query_id, doc_id, round(sum(a.raw / an.norm * (d.raw / dn.norm)), 6) as score from ar a join an using (query_id) join dr d using (bucket) join dn using (doc_id) group by all) select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from dots) where rank <= 10")
def d5_bucket_top_k(spark, sf_dir):
    """The nearest documents by hashed vectors."""
    items, alike = _buckets(spark, sf_dir)
    queries = alike(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text")
    return R.bucket_top_k(items, queries, 10).select("query_id", "doc_id", "score", "rank")


SQL["h3_hash_buckets_crc32"] = f"with recursive {CRC}, w as (select unnest({TOKENS.format('text')}) as term from documents), h as (select term, count(*) as n from w group by term) select ({_HASHED} % {R.WIDTH})::int as bucket, sum(n)::bigint as n from h, tab group by all"
