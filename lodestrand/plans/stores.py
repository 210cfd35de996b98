"""Stored indexes and catalogs, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import evaluate as E
from lodestrand.operators import index as I
from lodestrand.operators.shared import shared_dir
from lodestrand.plans import texts
from lodestrand.sources import catalog
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(texts.SQL["j7_tfidf_top_k"])
def a6_stored_index_search(spark, sf_dir):
    """An index of all documents as they were, a seventh of them otherwise or not yet there, refreshed to what they are, and searched."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark)
    before = docs.where("doc_id % 21 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 3, F.reverse("text")).otherwise(F.col("text")))
    gone = docs.where("doc_id % 50 = 1").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    I.refresh(before.union(gone), at, "doc_id", "text")
    I.refresh(docs, at, "doc_id", "text")
    found = I.search(I.load(spark, at), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), 10, F.col("key").cast("long"))
    return found.select("query_id", F.col("key").cast("long").alias("doc_id"), "score", "rank")


@query("select trim(regexp_replace(lower(source), '[^a-z0-9-]+', '-', 'g'), '-') as repo_id, source as name, count(*)::bigint as n_files, sum(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end)::bigint as n_lines from documents where source is not null group by source")
def a5_repository_catalog(spark, sf_dir):
    """A5: a catalog of the sources, put in by halves and then again as they are."""
    docs, at = table(spark, sf_dir, "documents").where("source is not null"), shared_dir(spark)
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)

    def rows(some):
        by = some.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(lines).cast("long").alias("n_lines"))
        return by.select(catalog.slug(F.col("name")).alias("repo_id"), "name", F.col("name").alias("root"), F.col("n_files").cast("string").alias("fingerprint"), "n_files", "n_lines")

    for some in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), docs):
        catalog.upsert(rows(some), at)
    return catalog.entries(spark, at).select("repo_id", "name", "n_files", "n_lines")


#: Turns of conversations as evaluated answers: what was expected, found, cited and said follows from their numbers and words.
_ANSWERS = {
    "id": "concat(conv_id, ':', turn)", "category": "case when conv_id % 5 = 0 then 'pr_review' when conv_id % 5 = 1 then 'test_generation' else role end", "task": "case when turn % 2 = 0 then 'search' else 'review' end",
    "verification": "case when turn % 3 = 0 then 'passed' when turn % 3 = 1 then 'failed' end", "total": "cast(conv_id % 4 as int)", "latency_ms": "cast(length(coalesce(text, '')) as double)", "answer": "text",
}
_LISTS = {
    "results": ["case when conv_id % 7 <> 0 then 'search' end", "case when conv_id % 3 = 0 then 'review' end"], "expected_files": ["case when turn % 4 <> 3 then concat('f', conv_id % 6) end", "case when turn % 4 = 1 then concat('f', turn % 6) end"],
    "retrieved": [f"concat('f', (conv_id + {i}) % 6)" for i in (1, 5, 3, 2)] + ["'f99'", "concat('f', conv_id % 6)"], "cited": ["case when conv_id % 2 = 0 then concat('f', conv_id % 6) end", "concat('f', turn % 6)"],
    "expect_keywords": ["case when turn % 2 = 1 then 'THE' end", "case when turn % 2 = 1 then 'a' end"], "expected_findings": ["'x'"], "findings": ["case when turn % 2 = 1 then 'x' end", "'y'"], "expect_verification": ["'passed'"],
}
_EVALUATED = (
    "a as (select " + ", ".join(f"{e} as {n}" for n, e in _ANSWERS.items()) + ", " + ", ".join(f"list_filter([{', '.join(v)}], lambda x: x is not null) as {n}" for n, v in _LISTS.items()) + " from conversations), "
    "m as (select *, case when len(expected_files) > 0 then len(list_filter(expected_files, lambda g: list_contains(retrieved[1:5], g))) / len(expected_files) end as recall_5, case when len(expected_files) > 0 then len(list_filter(expected_files, lambda g: list_contains(retrieved[1:10], g))) / len(expected_files) end as recall_10, "
    "case when len(expected_files) > 0 and len(cited) > 0 then len(list_filter(cited, lambda c: list_contains(expected_files, c))) / len(cited) end as citation, list_contains(results, task) as route_ok, "
    "len(expect_keywords) = 0 or len(list_filter(expect_keywords, lambda w: contains(lower(coalesce(answer, '')), lower(w)))) > 0 as said, len(list_filter(expected_files, lambda g: not contains(coalesce(answer, ''), g) and not contains(array_to_string(cited, ' '), g))) = 0 as shown from a), "
    "s as (select *, coalesce(case category when 'pr_review' then route_ok and said and len(list_filter(expected_findings, lambda f: not list_contains(findings, f))) = 0 when 'test_generation' then coalesce(list_contains(expect_verification, verification), false) and total > 0 else route_ok and said and shown end, false) as success from m)"
)


def evaluated(spark, sf_dir):
    lists = [F.array_compact(F.array(*[F.expr(e).cast("string") for e in v])).alias(n) for n, v in _LISTS.items()]
    return E.marked(table(spark, sf_dir, "conversations").select(*[F.expr(e).alias(n) for n, e in _ANSWERS.items()], *lists))


@query(f"with {_EVALUATED} select id, category, success, route_ok, round(recall_5, 4) as recall_5, round(recall_10, 4) as recall_10, round(citation, 4) as citation from s")
def d13_marked_answers(spark, sf_dir):
    """Success of each answer by the rules of its category, recalls and citations."""
    return evaluated(spark, sf_dir).select("id", "category", "success", "route_ok", *[F.round(c, 4).alias(c) for c in ("recall_5", "recall_10", "citation")])


@query(
    f"""with {_EVALUATED}, one as (select count(*) as questions, round(avg(recall_5), 3) as recall_5, round(avg(recall_10), 3) as recall_10, round(avg(citation), 3) as citation, round(avg(success::int), 3) as success, round(median(latency_ms), 1) as p50,
  round(list_sort(list(latency_ms))[round_even(0.95 * (count(*) - 1), 0)::bigint + 1], 1) as p95 from s), c as (select category, count(*) as questions, round(avg(success::int), 3) as success, round(avg(recall_5), 3) as recall_5 from s group by category)
select 'all' as category, questions, success, recall_5, recall_10, citation, p50, p95 from one union all select category, questions, success, recall_5, null, null, null, null from c"""
)
def o12_evaluation_summary(spark, sf_dir):
    """Figures over all answers and by category, read back from the written report."""
    rows, at = evaluated(spark, sf_dir), shared_dir(spark)
    E.write_report(rows, at)
    one = spark.read.schema("questions long, recall_5 double, recall_10 double, citation double, success double, latency_p50 double, latency_p95 double").json(f"{at}/summary.json")
    none = F.lit(None).cast("double")
    every = one.select(F.lit("all").alias("category"), "questions", "success", "recall_5", "recall_10", "citation", F.col("latency_p50").alias("p50"), F.col("latency_p95").alias("p95"))
    return every.union(E.by_category(spark.read.schema("category string, success boolean, recall_5 double").json(f"{at}/results.json")).select("category", "questions", "success", "recall_5", none, none, none, none))
