"""Queries over documents and pages: inventory, tokens, retrieval.  Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import retrieval as R
from lodestrand.operators.shared import written
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in X.STOP)
#: Tokens as SQL: extract, lower, split at underscores, filter, drop a plural s.
TOKENS = rf"""list_transform(list_filter(flatten(list_transform(regexp_extract_all({{0}}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: regexp_split_to_array(lower(w), '_+'))),
  lambda p: length(p) > 1 and p not in ({STOP})), lambda p: case when length(p) > 4 and p like '%s' and p not like '%ss' then p[1:length(p) - 1] else p end)"""
DOC_TERMS = f"""d as (select doc_id, unnest({TOKENS.format("text")}) as term from documents),
dc as (select doc_id, term, count(*) as n from d group by all),
nd as (select greatest(count(*), 1) as n_docs from documents),
w as (select term, count(*) as df, ln((max(n_docs) + 1.0) / (count(*) + 1.0)) + 1.0 as idf from dc, nd group by term)"""
VECTORS = """dr as (select doc_id, dc.term, (1 + ln(n::double)) * idf as raw from dc join w on dc.term = w.term),
dn as (select doc_id, sqrt(sum(raw * raw)) as norm from dr group by doc_id),
dv as (select dr.doc_id, term, raw / norm as w from dr join dn on dr.doc_id = dn.doc_id)"""
QUERY_TERMS = f"""q as (select item_id as query_id, unnest({TOKENS.format("text")}) as term from benchmark),
qc as (select query_id, term, count(*) as n from q group by all),
qr as (select query_id, qc.term, (1 + ln(n::double)) * coalesce(idf, ln(n_docs + 1.0) + 1.0) as raw from qc cross join nd left join w on qc.term = w.term),
qn as (select query_id, sqrt(sum(raw * raw)) as norm from qr group by query_id),
qv as (select qr.query_id, term, raw / norm as w from qr join qn on qr.query_id = qn.query_id)"""
DENSE = """dots as (select query_id, doc_id, round(sum(qv.w * dv.w), 6) as score from qv join dv on qv.term = dv.term group by all),
dense as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from dots)"""


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = written(R.term_counts(docs, "doc_id", "text"))  # read again for weights, vectors and overlaps
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"))
    weights = R.idf(counts, total)
    queries = R.term_counts(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text")
    return counts, weights, R.vectors(counts, weights, "doc_id"), queries, R.query_vectors(queries, weights, total)


@query("select source, doc_id, lang, n_chars, case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end as n_lines from documents")
def a1_file_inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars", X.line_count(F.col("text")).alias("n_lines"))


@query("select lang, count(*) as n_files, min(doc_id) as first_seen from documents group by lang")
def d1_language_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.min("doc_id").alias("first_seen"))


@query("select source, count(*) as n_files, sum(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as n_lines from documents group by source")
def d2_totals_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(X.line_count(F.col("text"))).cast("long").alias("n_lines"))


@query("select doc_id, n_chars from documents where n_chars <= 2000 order by source, doc_id limit 60")
def f10_size_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars <= 2000").orderBy("source", "doc_id").limit(60).select("doc_id", "n_chars")


@query(r"select page_id, regexp_matches(base, '^[0-9]+([.]html)?$') as numbered, regexp_replace(regexp_replace(lower(base), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from (select page_id, regexp_extract(url, '([^/]*)/?$', 1) as base from pages)")
def b1_path_predicate_and_slug(spark, sf_dir):
    base = F.regexp_extract("url", "([^/]*)/?$", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "pages").select("page_id", base.rlike("^[0-9]+([.]html)?$").alias("numbered"), slug.alias("slug"))


MARKERS = (("scripted", "<script"), ("linked", "href="), ("styled", "<style|class="), ("tabular", "<table"), ("listed", "<(ul|ol)"), ("image", "<img"))


@query("select marker, count(*) as n_pages, min(page_id) as first_page from (" + " union all ".join(f"select '{m}' as marker, page_id from pages where regexp_matches(html, '{p}')" for m, p in MARKERS) + ") group by marker")
def c21_marker_detection(spark, sf_dir):
    found = F.filter(F.array(*[F.when(F.col("html").rlike(p), m) for m, p in MARKERS]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


ROLES = (("english", "en"), ("german", "de"), ("romance", "fr"), ("romance", "es"))


@query("select role, count(distinct page_id) as n_pages from (select page_id, unnest(string_split(url, '/')) as seg from pages), (values " + ", ".join(f"('{r}', '{p}')" for r, p in ROLES) + ") as roles(role, prefix) where starts_with(seg, prefix) group by role")
def c22_directory_roles(spark, sf_dir):
    segments = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "/")).alias("seg"))
    roles = F.filter(F.array(*[F.when(F.col("seg").startswith(p), r) for r, p in ROLES]), lambda x: x.isNotNull())
    return segments.select("page_id", F.explode(roles).alias("role")).groupBy("role").agg(F.countDistinct("page_id").alias("n_pages"))


@query(f"with {DOC_TERMS} select doc_id, term, n from dc")
def h1_token_counts(spark, sf_dir):
    return R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"select gram, count(*) as n from (select unnest(list_transform(range(1, length(p) - 1), lambda i: p[i:i + 2])) as gram from (select '^' || unnest({TOKENS.format('text')}) || '$' as p from benchmark)) group by gram")
def h2_char_trigrams(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return words.select(F.explode(X.trigrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DOC_TERMS} select term, df, round(idf, 9) as idf from w")
def j3_idf_weights(spark, sf_dir):
    _, weights, *_ = _index(spark, sf_dir)
    return weights.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {DOC_TERMS}, {VECTORS} select doc_id, count(*) as n_terms, round(max(w), 6) as top_weight from dv group by doc_id")
def j4_tfidf_norms(spark, sf_dir):
    _, _, vectors, *_ = _index(spark, sf_dir)
    return vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("w"), 6).alias("top_weight"))


@query(f"select bucket, count(*) as n from (select (('0x' || substr(md5(unnest({TOKENS.format('text')})), 1, 8))::bigint % 4096)::int as bucket from documents) group by bucket")
def h3_hash_buckets_md5(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return words.groupBy(X.bucket_md5(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def h3_hash_buckets_crc32(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return words.groupBy(X.bucket_crc32(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {DOC_TERMS}, {VECTORS}, {QUERY_TERMS}, {DENSE} select query_id, doc_id, score, rank from dense where rank <= 10")
def j7_tfidf_top_k(spark, sf_dir):
    _, _, vectors, _, queries = _index(spark, sf_dir)
    return R.search(vectors, queries, 10)


@query(f"with {DOC_TERMS}, {VECTORS}, {QUERY_TERMS}, {DENSE} select query_id, doc_id, score, rank from dense where rank <= 10")
def j7_pruned_top_k(spark, sf_dir):
    """The same rows, with common terms read only for texts that can still be among the best."""
    _, _, vectors, _, queries = _index(spark, sf_dir)
    return R.pruned_search(written(vectors), queries, table(spark, sf_dir, "documents").count(), 10)


OVERLAP = """qs as (select query_id, count(*) as q from qc group by query_id),
kw as (select qc.query_id, doc_id, count(*) / (sqrt(any_value(q)::double) + 1e-9) as kw from qc join dc on qc.term = dc.term join qs on qc.query_id = qs.query_id group by qc.query_id, doc_id)"""


@query(f"with {DOC_TERMS}, {QUERY_TERMS}, {OVERLAP} select query_id, doc_id, round(kw, 6) as kw from kw where kw > 1")
def c14_lexical_overlap(spark, sf_dir):
    counts, _, _, queries, _ = _index(spark, sf_dir)
    return R.overlap(queries, counts).where("kw > 1").select("query_id", "doc_id", F.round("kw", 6).alias("kw"))


HYBRID = """hy as (select coalesce(kw.query_id, de.query_id) as query_id, coalesce(kw.doc_id, de.doc_id) as doc_id, coalesce(score, 0) as vec, coalesce(kw, 0) as kw
  from kw full join (select * from dense where rank <= 30) de on kw.query_id = de.query_id and kw.doc_id = de.doc_id),
hs as (select query_id, doc_id, vec, kw, round(0.55 * vec + 0.45 * least(kw, 1.0), 6) as score from hy),
hr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hs where score > 0.02)"""


@query(
    f"with {DOC_TERMS}, {VECTORS}, {QUERY_TERMS}, {DENSE}, {OVERLAP}, {HYBRID} select query_id, doc_id, score, rank, concat_ws('; ', case when kw >= 0.25 then 'strong keyword match' when kw > 0.05 then 'partial keyword match' end, "
    "case when vec >= 0.35 then 'high semantic similarity' when vec > 0.15 then 'moderate semantic similarity' end) as reason from hr where rank <= 10"
)
def j8_hybrid_search(spark, sf_dir):
    counts, _, vectors, terms, queries = _index(spark, sf_dir)
    hits = R.hybrid(R.search(vectors, queries, 30), R.overlap(terms, counts))
    return R.reasons(R.top_k(hits, "query_id", "doc_id", "score", 10)).select("query_id", "doc_id", "score", "rank", "reason")


@query(
    "with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id as doc_id, round(list_dot_product(qv::double[], embedding::double[]), 5) as score from q, embeddings where query_id <> vec_id), "
    "r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, rank from r where rank <= 10"
)
def j7_dense_top_k(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    queries = items.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("qv"))
    return R.dense_top_k(items, queries, 10).select("query_id", "doc_id", "score", "rank")


LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"


@query(f"with {LINES}, s as (select doc_id, line_no, len(regexp_extract_all(line, 'th')) as hits from l) select doc_id, line_no, hits from (select *, row_number() over (partition by doc_id order by hits desc, line_no) as rn from s) where rn = 1")
def d18_best_context_line(spark, sf_dir):
    from lodestrand.operators.rules import first_wins, lines

    scored = lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line_no", F.size(F.regexp_extract_all("line", F.lit("th"), F.lit(0))).alias("hits"))
    return first_wins(scored, ["doc_id"], F.desc("hits"), "line_no")


@query("select source, doc_id from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn = 1 order by source limit 15")
def e3_one_per_source(spark, sf_dir):
    from lodestrand.operators.rules import first_wins

    return first_wins(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], F.desc("n_chars"), "doc_id").orderBy("source").limit(15).select("source", "doc_id")


@query("select doc_id, ord, piece from (select doc_id, unnest(range(0, (length(text) + 1199) // 1200)) as ord, text from documents), lateral (select substr(text, ord * 1200 + 1, 1200) as piece)")
def j1_chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("parts", F.expr("ceil(length(text) / 1200.0)"))
    cut = docs.where("parts > 0").select("doc_id", "text", F.explode(F.expr("sequence(0L, cast(parts as bigint) - 1)")).alias("ord"))
    return cut.select("doc_id", "ord", F.expr("substring(text, cast(ord * 1200 + 1 as int), 1200)").alias("piece"))


@query(r"select page_id, target, min(pos) as first_pos from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), 1) - 1 as pos from pages) group by page_id, target")
def i1_link_edges(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "target"))
    return links.groupBy("page_id", "target").agg(F.min("pos").cast("long").alias("first_pos"))


HINTS = ("/en/1", "/de/", "/fr/9", "/es/53")


@query(
    "with p as (select page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) as path from pages), h as (select unnest([" + ", ".join(f"'{h}'" for h in HINTS) + "]) as hint), "
    "m as (select hint, page_id, path, row_number() over (partition by hint order by (path = hint) desc, length(path) desc, page_id) as rn from h, p where contains(path, hint) or (path <> '' and contains(hint, path))) select hint, page_id, path from m where rn = 1"
)
def c10_route_hint(spark, sf_dir):
    from lodestrand.operators.rules import first_wins

    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    hints = F.filter(F.array(*map(F.lit, HINTS)), lambda h: F.col("path").contains(h) | ((F.col("path") != "") & F.contains(h, F.col("path"))))
    met = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", F.explode(hints).alias("hint"))
    return first_wins(met, ["hint"], F.desc(F.col("path") == F.col("hint")), F.desc(F.length("path")), "page_id").select("hint", "page_id", "path")


@query("with s as (select page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') as p from pages) select page_id, array_to_string(p[len(p) - 1:len(p)], '.') as module, coalesce(m.n, 0) as siblings from s left join (select array_to_string(p[len(p) - 1:len(p)], '.') as k, count(*) as n from s group by k) m on m.k = array_to_string(p[len(p) - 1:len(p)], '.')")
def c1_module_lookup(spark, sf_dir):
    parts = F.split(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]")
    rows = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("module"))
    known = rows.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(known, "module", "left").select("page_id", "module", F.coalesce("n", F.lit(0)).alias("siblings"))


@query("select page_id, url, layer, row_number() over (partition by layer order by page_id)::int as step from (select page_id, url, case when contains(url, '/en/') then 0 when contains(url, '/de/') then 1 when contains(url, '.html') then 2 else 3 end as layer from pages) qualify step <= 5")
def f8_flow_layers(spark, sf_dir):
    from pyspark.sql import Window

    layer = F.when(F.col("url").contains("/en/"), 0).when(F.col("url").contains("/de/"), 1).when(F.col("url").contains(".html"), 2).otherwise(3)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", layer.alias("layer"))
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("layer").orderBy("page_id"))).where("step <= 5")


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n_numbers, coalesce(try_cast(nullif(regexp_extract(text, '([0-9]{1,9})', 1), '') as bigint), 0) as first_number from documents where regexp_matches(text, '[0-9]')")
def d20_number_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    first = F.nullif(F.regexp_extract("text", "([0-9]{1,9})", 1), F.lit("")).cast("long")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"), F.coalesce(first, F.lit(0)).alias("first_number"))


@query(f"with {LINES} select doc_id, min(line_no)::int as line_no from l where contains(line, 'License') group by doc_id")
def c24_first_mention(spark, sf_dir):
    from lodestrand.operators.rules import lines

    return lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("line").contains("License")).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


ENTRIES = ("src3", "src0", "src7", "main")


@query("select name, ordinal from (values " + ", ".join(f"('{n}', {i})" for i, n in enumerate(ENTRIES)) + ") as c(name, ordinal) where exists (select 1 from documents where source = name) order by ordinal")
def c23_entry_points(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for i, n in enumerate(ENTRIES) for x in (n, i)])
    present = table(spark, sf_dir, "documents").where(F.col("source").isin(*ENTRIES)).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return present.select("name", F.try_element_at(names, F.col("name")).alias("ordinal")).orderBy("ordinal")
