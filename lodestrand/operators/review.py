"""Review of unified diffs: findings (diff_id, file, line, category, severity, title, snippet) from the rows of ``diffs.parse``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import indent
from lodestrand.operators import detect, diffs
from lodestrand.operators.rules import SECRETS, severity_rank

#: What tells that a line checks who asks, what takes its place, and what a query looks like.
AUTH = r"(?i)auth|token|Depends[(]|@requires|get_current_user|verify_token|login_required|permission"
AUTH_AGAIN = r"(?i)decode_token|verify_?[A-Za-z0-9_]*token|verify_signature|Depends[(]|get_current_user|require[sd]?_|auth_middleware|login_required|check_permissions?"
LOOP_HEAD, QUERY = r"^for[ \t]+[A-Za-z0-9_]+.*:[ \t]*$", r"(^|[^A-Za-z0-9_])(db|cursor|session|conn)[.](execute|query[A-Za-z0-9_]*|get|find|insert|update)[ \t]*[(]"
#: Checks of added lines, all that fit: (category, severity, title, test).
ADDED = (
    ("sql_injection", "HIGH", "Potential SQL injection risk", detect.builds_sql), ("dangerous_call", "HIGH", "Dangerous call introduced", lambda t: t.rlike(detect.DANGEROUS)),
    ("swallowed_error", "MEDIUM", "Broad exception handler swallows errors", lambda t: t.rlike(detect.SWALLOWED) | t.rlike(detect.BARE_HANDLER)), ("mutable_default", "MEDIUM", "Mutable default argument", lambda t: t.rlike(detect.MUTABLE_DEFAULT)),
    ("todo", "LOW", "TODO/FIXME introduced in diff", lambda t: t.rlike(detect.TODO)), ("style", "LOW", "Use `is None` instead of `== None`", lambda t: t.rlike(detect.EQUALS_NONE)),
)
MOST_LINES, NEAR = 80, 5


def _found(rows: DataFrame, category: str, severity: str, title: Column | str, snippet: Column | None = None) -> DataFrame:
    said = F.lit(title) if isinstance(title, str) else title
    return rows.select("diff_id", F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), said.alias("title"), F.substring(F.trim("text") if snippet is None else snippet, 1, 160).alias("snippet"))


def added_lines(rows: DataFrame) -> DataFrame:
    checks = F.array(*[F.when(test(F.col("text")), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(t).alias("title"))) for c, s, t, test in ADDED])
    each = rows.where("op = '+'").select("diff_id", F.col("path").alias("file"), "line", F.explode(F.array_compact(checks)).alias("x"), F.substring(F.trim("text"), 1, 160).alias("snippet"))
    return each.select("diff_id", "file", "line", "x.category", "x.severity", "x.title", "snippet")


def secret_lines(rows: DataFrame) -> DataFrame:
    """The first kind of secret in an added line that doesn't read the environment; runs of six characters or more are masked."""
    kind = F.lit(None).cast("string")
    for name, _, pattern in reversed(SECRETS):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    found = rows.where((F.col("op") == "+") & ~F.col("text").contains("environ") & ~F.col("text").contains("getenv")).withColumn("kind", kind).where("kind is not null")
    masked = F.regexp_replace("text", "([A-Za-z0-9_/+-]{4})[A-Za-z0-9_/+-]{2,}", "$1***")
    return _found(found, "hardcoded_secret", "HIGH", F.concat("kind", F.lit(" committed in the diff")), masked)


def removed_auth(rows: DataFrame) -> DataFrame:
    """A file that loses a check of who asks and gains none."""
    gone, back = (F.col("op") == "-") & F.col("text").rlike(AUTH), (F.col("op") == "+") & F.col("text").rlike(AUTH_AGAIN)
    first = lambda when, what: F.min_by(F.when(when, F.col(what)), F.when(when, F.col("seq")))
    by = rows.groupBy("diff_id", "path").agg(F.max(gone).alias("gone"), F.max(back).alias("back"), first(gone, "text").alias("text"), F.coalesce(first(F.col("op") == "+", "line"), F.lit(1)).alias("line"))
    return _found(by.where("gone and not back"), "removed_auth", "HIGH", "Authentication / token verification removed")


def breaking_changes(rows: DataFrame) -> DataFrame:
    lost = diffs.lost_parameters(rows)
    names = rows.where("op = '+'").withColumn("name", F.regexp_extract("text", r"^\s*def ([A-Za-z_0-9]+)", 1)).where("name <> ''")
    found = names.join(lost, ["diff_id", "path", "name"])
    return _found(found, "breaking_change", "MEDIUM", F.concat(F.lit("Breaking change to "), "name", F.lit("(): parameter(s) removed: "), F.array_join(F.array_sort("lost"), ", ")))


def loop_queries(rows: DataFrame) -> DataFrame:
    """The first query in an added loop, before a line that stands no deeper than the loop's head."""
    added = rows.where("op = '+'").withColumn("stripped", F.regexp_replace("text", r"^\s+", "")).withColumn("indent", indent(F.col("text")))
    head = F.col("stripped").rlike(LOOP_HEAD)
    along = Window.partitionBy("diff_id", "path").orderBy("seq")
    rows = added.withColumn("head", head).withColumn("loop", F.count_if("head").over(along)).where("loop > 0")
    inside = Window.partitionBy("diff_id", "path", "loop").orderBy("seq")
    rows = rows.withColumn("depth", F.first("indent").over(inside))
    closed = F.max(~F.col("head") & (F.col("stripped") != "") & (F.col("indent") <= F.col("depth"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hit", F.col("text").rlike(QUERY) & ~F.col("head") & ~closed)
    rows = rows.withColumn("before", F.coalesce(F.max("hit").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("hit and not before")
    return _found(rows, "n_plus_one", "MEDIUM", "Query executed inside a loop (N+1 pattern)")


def missing_tests(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed files with new logic, no tests themselves, that no test (path, test) covers."""
    base = F.substring_index("path", "/", -1)
    added = rows.where((F.col("op") == "+") & ~(base.startswith("test_") | F.col("path").contains("/tests/")))
    by = added.groupBy("diff_id", "path").agg(F.max(F.col("text").rlike(r"(^|[^A-Za-z0-9_])def([^A-Za-z0-9_]|$)|=>")).alias("logic"), F.min_by("line", "seq").alias("line"), F.min_by("text", "seq").alias("text"))
    return _found(by.where("logic").join(tests.select("path"), "path", "left_anti"), "missing_tests", "MEDIUM", "No unit test for the changed code", F.substring(F.trim("text"), 1, 120))


def long_functions(rows: DataFrame, symbols: DataFrame, most: int = MOST_LINES) -> DataFrame:
    size = F.col("end_line") - F.col("start_line")
    long = symbols.where((F.col("kind") != "class") & (size > most)).select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("signature").alias("text"), "qualified", size.alias("size"))
    return _found(rows.select("diff_id", "path").distinct().join(long, "path"), "maintainability", "LOW", F.concat("qualified", F.lit(" is "), "size", F.lit(" lines long")))


def near_touched(rows: DataFrame, findings: DataFrame, near: int = NEAR) -> DataFrame:
    """Findings of the repository within ``near`` lines of an added one; an equality join of bands of lines."""
    width = near + 1
    touched = rows.where("op = '+'").select("diff_id", F.col("path").alias("file"), F.col("line").alias("touched"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("line") / width) + d)).alias("band"))
    met = findings.withColumn("band", F.floor(F.col("line") / width)).join(touched, ["file", "band"]).where(F.abs(F.col("line") - F.col("touched")) <= near)
    return met.select("diff_id", "file", "line", "category", "severity", "title", "snippet").distinct()


def review(diff: DataFrame, files: DataFrame, symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """All findings of each diff once, with their rank by severity, file and line; the first 12 are cited."""
    rows = diffs.parse(diff)
    own = detect.run_checks(files, symbols, symbols, ["sql_injection", "unhandled_none", "n_plus_one"])
    found = [added_lines(rows), secret_lines(rows), removed_auth(rows), breaking_changes(rows), loop_queries(rows), missing_tests(rows, tests), long_functions(rows, symbols), near_touched(rows, own)]
    return ranked(reduce(DataFrame.unionByName, found))


def ranked(findings: DataFrame) -> DataFrame:
    once = findings.groupBy("diff_id", "category", "file", "line", "title").agg(F.min("severity").alias("severity"), F.min("snippet").alias("snippet"))
    order = Window.partitionBy("diff_id").orderBy(severity_rank(F.col("severity")), "file", "line", "category", "title")
    return once.withColumn("rank", F.row_number().over(order)).withColumn("cited", F.col("rank") <= 12)
