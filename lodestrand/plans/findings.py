"""Queries of the rule engine: secrets, line rules, redaction, ranking; intents and targets of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions.text import masked
from lodestrand.operators import rules as K
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(rules, what: int) -> str:
    return "case " + " ".join(f"when regexp_matches(line, {_quoted(r[2])}) then '{r[what]}'" for r in rules) + " end"


LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"
SECRET_ROWS = f"{LINES}, f as (select doc_id, line_no, line, {_case(K.SECRETS, 0)} as category, {_case(K.SECRETS, 1)} as severity from l)"
QUALITY_ROWS = f"{LINES}, f as (select doc_id, line_no, line, {_case(K.QUALITY, 0)} as category, {_case(K.QUALITY, 1)} as severity from l)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"with {SECRET_ROWS} select doc_id, line_no::int as line_no, category, severity from f where category is not null")
def k11_secret_scan(spark, sf_dir):
    return K.scan(_docs(spark, sf_dir), "doc_id", "text", K.SECRETS).select("doc_id", "line_no", "category", "severity")


@query(f"with {SECRET_ROWS} select source, " + ", ".join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in ("HIGH", "MEDIUM", "LOW")) + " from documents d left join f on d.doc_id = f.doc_id and category is not null group by source")
def d7_severity_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = docs.select("doc_id", "source").join(K.scan(docs, "doc_id", "text", K.SECRETS), "doc_id", "left")
    return found.groupBy("source").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])


_redact = "text"
for _, _, _p in K.SECRETS:
    _redact = f"regexp_replace({_redact}, {_quoted(_p)}, '***REDACTED***', 'g')"


@query(f"select doc_id, md5({_redact}) as redacted_md5 from documents")
def k12_redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(K.redacted(F.col("text")).cast("binary")).alias("redacted_md5"))


@query(r"with " + SECRET_ROWS + r" select doc_id, line_no::int as line_no, regexp_replace(line, '([A-Za-z0-9_/+-]{4})[A-Za-z0-9_/+-]{12,}', '\1***', 'g') as snippet from f where category is not null")
def h8_masked_snippets(spark, sf_dir):
    return K.scan(_docs(spark, sf_dir), "doc_id", "text", K.SECRETS).select("doc_id", "line_no", masked(F.col("line")).alias("snippet"))


@query(f"with {QUALITY_ROWS} select doc_id, line_no::int as line_no, category, severity from f where category is not null")
def k5_line_rules(spark, sf_dir):
    return K.scan(_docs(spark, sf_dir), "doc_id", "text", K.QUALITY).select("doc_id", "line_no", "category", "severity")


@query(
    f"with {QUALITY_ROWS}, g as (select *, row_number() over (partition by doc_id, category order by line_no) as rn from f where category is not null) "
    "select doc_id, category, line_no::int as line_no, row_number() over (partition by doc_id order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, line_no)::int as rank from g where rn = 1"
)
def d14_findings_dedup_rank(spark, sf_dir):
    from pyspark.sql import Window

    once = K.first_wins(K.scan(_docs(spark, sf_dir), "doc_id", "text", K.QUALITY), ["doc_id", "category"], "line_no")
    order = Window.partitionBy("doc_id").orderBy(K.severity_rank(F.col("severity")), "line_no")
    return once.select("doc_id", "category", "line_no", F.row_number().over(order).alias("rank"))


@query("select page_id, instr(html, 'href=') as first_href from pages where contains(html, 'href=')")
def k15_first_reference(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("html").contains("href=")).select("page_id", F.instr("html", "href=").cast("long").alias("first_href"))


INTENTS = (("review", "(review|diff|change)"), ("testgen", "(test|check)"), ("analyst", "(architecture|overview|structure)"), ("investigate", "(error|bug|fail|why)"), ("search", "(where|find|which|how)"))


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{i}'" for i, p in INTENTS) + " else 'search' end as intent from conversations")
def o1_classify_intent(spark, sf_dir):
    low, out = F.lower("text"), F.lit("search")
    for intent, pattern in reversed(INTENTS):
        out = F.when(low.rlike(pattern), intent).otherwise(out)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("intent"))


@query(r"select conv_id, turn, coalesce(nullif(regexp_extract(text, '`([^`]+)`', 1), ''), nullif(regexp_extract(text, '\"([^\"]+)\"', 1), ''), nullif(regexp_extract(text, '([A-Za-z]{6,})', 1), '')) as target from conversations")
def o2_extract_target(spark, sf_dir):
    got = [F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ("`([^`]+)`", '"([^"]+)"', "([A-Za-z]{6,})")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(*got).alias("target"))


@query("select conv_id, turn, contains(lower(text), 'the') or contains(lower(text), 'that') as any_hit, (contains(lower(text), 'the')::int + contains(lower(text), 'that')::int + contains(lower(text), 'and')::int) as relevance from conversations")
def o11_keyword_relevance(spark, sf_dir):
    low = F.lower("text")
    hits = [low.contains(t) for t in ("the", "that", "and")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (hits[0] | hits[1]).alias("any_hit"), (hits[0].cast("int") + hits[1].cast("int") + hits[2].cast("int")).alias("relevance"))


@query("with s as (select source, doc_id, lang, row_number() over (partition by source, lang order by doc_id) as rn from documents) select source, string_agg(lang || ':' || doc_id, ', ' order by lang) as cited from s where rn = 1 group by source")
def o5_citations_compose(spark, sf_dir):
    once = K.first_wins(_docs(spark, sf_dir).select("source", "doc_id", "lang"), ["source", "lang"], "doc_id")
    pairs = F.array_sort(F.collect_list(F.struct("lang", "doc_id")))
    return once.groupBy("source").agg(F.concat_ws(", ", F.transform(pairs, lambda p: F.concat(p["lang"], F.lit(":"), p["doc_id"].cast("string")))).alias("cited"))
