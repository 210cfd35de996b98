"""Evaluation of answers: the questions' source, success by category, figures over all questions, and the report's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.sequences import rank_percentile

QUESTIONS = (
    "id string, category string, task string, question string, diff string, target string, expected_files array<string>, expect_keywords array<string>, expected_findings array<string>, expect_verification array<string>"
)
#: Categories whose success is judged by findings and by test runs; all others by files and words.
REVIEWS, TESTS = "pr_review", "test_generation"


def questions(spark: SparkSession, path: str, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The questions of a folder of JSON lines, of some categories or the first ``limit`` by id if given; absent lists are empty."""
    rows = spark.read.schema(QUESTIONS).json(path)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("expected_files", "expect_keywords", "expected_findings", "expect_verification")})
    rows = rows.where(F.col("category").isin(categories)) if categories else rows
    return rows.orderBy("id").limit(limit) if limit else rows


def _share(of: Column, among: Column) -> Column:
    return F.size(F.filter(of, lambda x: F.array_contains(among, x))) / F.size(of)


def marked(answers: DataFrame) -> DataFrame:
    """Adds recall_5, recall_10, citation, route_ok and success.

    answers: the questions' columns with results (array of the tasks that gave one), retrieved, cited, answer, findings, verification, total.
    recall is null without expected files, citation if either side is empty.  A review succeeds if all expected findings are among its own, a test
    generation if its verdict is an expected one of some tests, any other question if every expected file is in the answer or in what it cites; all
    need a result of their task, and reviews and other questions one of the expected words, in any case, if there are any.
    """
    gold, cited = F.col("expected_files"), F.col("cited")
    recall = lambda k: F.when(F.size(gold) > 0, _share(gold, F.slice("retrieved", 1, k)))
    citation = F.when((F.size(gold) > 0) & (F.size(cited) > 0), _share(cited, gold))
    said = (F.size("expect_keywords") == 0) | F.exists("expect_keywords", lambda w: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(w)))
    route = F.array_contains("results", F.col("task"))
    all_cited = F.array_join(cited, " ")
    shown = F.forall(gold, lambda g: F.contains(F.coalesce("answer", F.lit("")), g) | F.contains(all_cited, g))
    success = (
        F.when(F.col("category") == REVIEWS, route & said & (F.size(F.array_except("expected_findings", "findings")) == 0))
        .when(F.col("category") == TESTS, F.coalesce(F.array_contains("expect_verification", F.col("verification")), F.lit(False)) & (F.coalesce("total", F.lit(0)) > 0))
        .otherwise(route & said & shown)
    )
    return answers.withColumns({"recall_5": recall(5), "recall_10": recall(10), "citation": citation, "route_ok": route, "success": F.coalesce(success, F.lit(False))})


def _mean(c: Column) -> Column:
    return F.round(F.avg(c), 3)


def summary(rows: DataFrame) -> DataFrame:
    """One row: questions, recalls, citation, success, latency_p50 and latency_p95 of all marked answers."""
    told = rows.agg(F.count(F.lit(1)).alias("questions"), _mean(F.col("recall_5")).alias("recall_5"), _mean(F.col("recall_10")).alias("recall_10"), _mean(F.col("citation")).alias("citation"), _mean(F.col("success").cast("double")).alias("success"), F.round(F.median("latency_ms"), 1).alias("latency_p50"))
    last = rank_percentile(rows.select(F.lit(1).alias("all"), F.col("latency_ms").cast("double").alias("latency_ms")), "all", "latency_ms", 0.95).agg(F.round(F.max("value"), 1).alias("latency_p95"))
    return told.crossJoin(F.broadcast(last))  # one row each


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("questions"), _mean(F.col("success").cast("double")).alias("success"), _mean(F.col("recall_5")).alias("recall_5"))


def markdown(rows: DataFrame) -> DataFrame:
    """(part, ord, text): the report's lines, in order of part and ord: figures, a table of categories, a table of questions."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = lambda label, *c: F.concat(F.lit(f"{label}: **"), *c, F.lit("**"))
    head = F.array(
        F.lit("# Evaluation report"), F.lit(""), line("Questions", text("questions")), line("Retrieval Recall@5", text("recall_5")), line("Retrieval Recall@10", text("recall_10")), line("Citation correctness", text("citation")),
        line("Task success", text("success")), line("Latency p50 / p95", text("latency_p50"), F.lit(" ms / "), text("latency_p95"), F.lit(" ms")), F.lit(""), F.lit("| Category | Questions | Task success | Recall@5 |"), F.lit("|---|---|---|---|"),
    )
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    titles = F.array(F.lit(""), F.lit("## Per-question results"), F.lit(""), F.lit("| id | category | success | recall@5 | latency (ms) |"), F.lit("|---|---|---|---|---|"))
    one = summary(rows)
    parts = one.select(F.lit(0).alias("part"), F.posexplode(head).alias("ord", "text")).select("part", F.format_string("%09d", "ord").alias("ord"), "text")
    parts = parts.union(by_category(rows).select(F.lit(1), "category", row("category", text("questions"), text("success"), text("recall_5"))))
    parts = parts.union(one.select(F.lit(2), F.posexplode(titles).alias("ord", "text")).select(F.lit(2), F.format_string("%09d", "ord"), "text"))
    return parts.union(rows.select(F.lit(3), "id", row("id", "category", F.when(F.col("success"), "✅").otherwise("❌"), text("recall_5"), text("latency_ms"))))


def write_report(rows: DataFrame, path: str) -> None:
    """``results.json``: a line a question; ``summary.json``: the figures; ``results.md``: the report, its lines in order over the folder's files."""
    rows.write.mode("overwrite").json(f"{path}/results.json")
    summary(rows).write.mode("overwrite").json(f"{path}/summary.json")
    markdown(rows).orderBy("part", "ord").select("text").write.mode("overwrite").text(f"{path}/results.md")
