"""Detectors over source code: findings (file, line, category, severity, title, snippet), each by one pass over lines or function bodies.

``files`` has path, language and content; ``symbols`` and ``routes`` are relations of ``operators.code``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import split_lines
from lodestrand.operators.code import unread
from lodestrand.operators.shared import written

#: What lines are tested for.  Classes are spelled out and nothing looks around, so every engine reads them alike.
SQL_BUILD = r"(?i)(execute|executemany|query_all|query_one|cursor[.][A-Za-z0-9_]+)[ \t]*[(][ \t]*f[\"']|(execute|executemany)[ \t]*[(][ \t]*[\"'][^\"']*(SELECT|INSERT|UPDATE|DELETE)[^\"']*[\"'][ \t]*[+]|(^|[^A-Za-z0-9_])format[(][ \t]*[\"'](SELECT|INSERT|UPDATE|DELETE)"
SQL_FORMATTED = r"(?i)f[\"'][^\"']*(SELECT |INSERT |UPDATE |DELETE )"
SWALLOWED = r"except[ \t]*(Exception|BaseException)?[ \t]*(as[ \t]+[A-Za-z0-9_]+)?[ \t]*:[ \t]*(pass|[.][.][.])"
BARE_HANDLER = r"^[ \t]*except[ \t]*(Exception|BaseException)?[ \t]*(as[ \t]+[A-Za-z0-9_]+)?[ \t]*:[ \t]*$"
DANGEROUS = r"(^|[^A-Za-z0-9_])(eval|exec)[ \t]*[(]|(^|[^A-Za-z0-9_])os[.]system[ \t]*[(]|subprocess[.][A-Za-z0-9_]+[(][^)]*shell[ \t]*=[ \t]*True"
WEAK_HASH = r"hashlib[.](md5|sha1)[ \t]*[(]"
MUTABLE_DEFAULT = r"def[ \t]+[A-Za-z0-9_]+[ \t]*[(][^)]*=[ \t]*(\[\]|[{][}])"
EQUALS_NONE = r"==[ \t]*None|!=[ \t]*None"
TODO = r"(^|[^A-Za-z0-9_])(TODO|FIXME|XXX|HACK)([^A-Za-z0-9_]|$)"
HANDLED = r"(^|[^A-Za-z0-9_])try[ \t]*:|except([^A-Za-z0-9_]|$)|raise HTTPException"
LOOP, LOOP_END, LOOP_QUERY = r"^[ \t]*for[ \t]+[A-Za-z0-9_]+.*:", r"^[ \t]{0,3}[A-Za-z0-9_]", r"(^|[^A-Za-z0-9_])(db|cursor)[.](execute|query_all|query_one)[ \t]*[(]"
MAY_BE_NONE = r"^[ \t]*([A-Za-z0-9_]+)[ \t]*=[ \t]*([A-Za-z0-9_.]*?(get_|find_|fetch_|query_)[A-Za-z0-9_]+[ \t]*[(].*)$"
RATE = r"^(?i)(discount|rate|ratio|percent|percentage|commission|fee|tax)$"
FIELD, QUOTED, VALIDATES = r"body([.]get[(][ \t]*|\[)[ \t]*[\"']([A-Za-z0-9_]+)[\"']", r"[\"']([A-Za-z0-9_]+)[\"']", r"(?i)validat|assert|check_|sanitize|verify"
PARAMETER = r"[(, \t]([A-Za-z0-9_]+)(:[ \t]*[A-Za-z0-9_\[\]., ]+)?([ \t]*=[ \t]*[^,)]+)?"


def code_lines(files: DataFrame) -> DataFrame:
    """(file, language, line from 1, text)."""
    return files.select(F.col("path").alias("file"), "language", F.posexplode(split_lines(F.col("content"))).alias("pos", "text")).select("file", "language", (F.col("pos") + 1).alias("line"), "text")


def bodies(files: DataFrame | None, symbols: DataFrame, python: bool = True) -> DataFrame:
    """(file, symbol, start_line, signature, line, text): the lines of each function of ``files`` (of all symbols' files if None), with its own line.

    Symbols that were parsed bring their lines along, so texts are neither split nor moved.
    """
    functions = symbols.where("kind <> 'class'").withColumn("symbol", F.col("qualified"))
    if files is not None and python:
        files = files.where("language = 'python'")
    if "body_lines" in symbols.columns:
        if files is not None:
            functions = functions.join(files.select(F.col("path").alias("file")), "file", "left_semi")
        lines = F.col("body_lines")
    else:
        functions = functions.join(files.select(F.col("path").alias("file"), split_lines(F.col("content")).alias("lines")), "file")
        lines = F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    own = functions.select("file", "symbol", "start_line", "signature", F.posexplode(lines).alias("pos", "text"))
    return own.select("file", "symbol", "start_line", "signature", (F.col("start_line") + F.col("pos")).alias("line"), "text")


#: Why a finding of a category matters; {0}, {1}, ... are what was found.
RATIONALES = {
    "unhandled_none": "`{0}` is assigned from `{1}` which can return None (assignment at line {2}); line {3} then uses `{0}` directly, which raises TypeError/AttributeError when None.",
    "sql_injection": "User-controlled values interpolated directly into SQL text instead of bound parameters (? placeholders).",
    "swallowed_error": "`except: pass` hides failures and turns bugs into silent wrong behaviour.",
    "dangerous_call": "eval/exec/os.system/shell=True execute attacker-influenceable strings.",
    "mutable_default": "Mutable defaults ([]/{}) are shared across calls — a classic Python bug source.",
    "style": "PEP 8: use `is None` / `is not None`.",
    "weak_crypto": "MD5/SHA1 are not password hashing functions; use bcrypt/scrypt/argon2 with a salt.",
    "todo": "Unfinished work tracked in a comment.",
    "missing_error_handling": "Any exception from the service/data layers escapes as a raw HTTP 500 instead of a precise status code.",
    "n_plus_one": "One DB round-trip per item; batch the inserts/queries instead.",
    "missing_validation": "`{0}` looks like a fraction (0..1) but is never guarded with an `if` — values below 0 or above 1 produce out-of-range results (e.g. negative totals).",
    "missing_input_validation": "Request-body fields reach the service layer without any validate_/assert/check call — malformed input propagates downstream (or causes 500s).",
    "dead_store": "`{0}` is accumulated inside a loop in {1}() but never read afterwards; {2}one of the two computations is redundant or the wrong one was wired up.",
}


def rationale(category: str, *found: Column) -> Column:
    parts = re.split(r"[{]([0-9])[}]", RATIONALES[category])
    return F.concat(*[found[int(x)].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def finding(rows: DataFrame, category: str, severity: str, title: Column | str, line: str = "line", snippet: Column | None = None, found: tuple[Column, ...] = ()) -> DataFrame:
    said = F.lit(title) if isinstance(title, str) else title
    shown = F.substring(F.trim("text") if snippet is None else snippet, 1, 160)
    return rows.select("file", F.col(line).cast("int").alias("line"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), said.alias("title"), shown.alias("snippet"), rationale(category, *found).alias("rationale"))


def builds_sql(text: Column) -> Column:
    """SQL put together from strings; names in braces that are all upper-case are constants and do no harm."""
    names = F.regexp_extract_all(text, F.lit(r"[{]([A-Za-z0-9_]+)[}]"), F.lit(1))
    constant = F.forall(names, lambda n: (n == F.upper(n)) & n.rlike("[A-Z]"))
    return F.when(F.size(names) > 0, ~constant & (text.rlike(SQL_BUILD) | text.rlike(SQL_FORMATTED))).otherwise(text.rlike(SQL_BUILD))


#: Rules of lines: (category, severity, title, what a line is tested for, in small letters the words of which a line that fits has one and that are looked for first); of the last four the first that fits a line holds.
LINE_RULES = (
    ("sql_injection", "HIGH", "SQL built via string interpolation (injection risk)", lambda text, secret: builds_sql(text), ("execute", "query_all", "query_one", "cursor.", "format(", "select ", "insert ", "update ", "delete ")),
    ("swallowed_error", "MEDIUM", "Broad except swallows the error", lambda text, secret: text.rlike(SWALLOWED), ("except",)),
    ("dangerous_call", "HIGH", "Dangerous call (eval/exec/shell)", lambda text, secret: text.rlike(DANGEROUS), ("eval", "exec", "os.system", "subprocess.")),
)
QUALITY = (
    ("mutable_default", "MEDIUM", "Mutable default argument", lambda text, secret: text.rlike(MUTABLE_DEFAULT), ("[]", "{}")),
    ("style", "LOW", "Comparison to None should use `is`", lambda text, secret: text.rlike(EQUALS_NONE), ("==", "!=")),
    ("weak_crypto", "MEDIUM", "Weak hash used in a password context", lambda text, secret: text.rlike(WEAK_HASH) & secret, ("hashlib.",)),
    ("todo", "LOW", "TODO/FIXME marker left in code", lambda text, secret: text.rlike(TODO), ("todo", "fixme", "xxx", "hack")),
)


def line_findings(files: DataFrame, rules, first_of=()) -> DataFrame:
    """Findings of all ``rules``, and of ``first_of`` the first that fits a line, from one pass over all lines."""
    lines = code_lines(files.withColumn("language", F.lower("content").contains("password").cast("string")))
    secret = F.col("language") == "true"
    said = lambda r: F.struct(F.lit(r[0]).alias("category"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("title"), rationale(r[0]).alias("rationale"))
    low = F.lower("text")
    has = lambda r: reduce(Column.__or__, [low.contains(w) for w in r[4]])
    fits = lambda r: F.when(has(r) & r[3](F.col("text"), secret), said(r))
    found = [fits(r) for r in rules]
    if first_of:
        found.append(F.coalesce(*[fits(r) for r in first_of]))
    lines = lines.where(reduce(Column.__or__, [has(r) for r in (*rules, *first_of)]))  # patterns are tried on few lines
    each = lines.select("file", F.col("line").cast("int").alias("line"), "text", F.explode(F.array_compact(F.array(*found))).alias("r"))
    return each.select("file", "line", "r.category", "r.severity", "r.title", F.substring(F.trim("text"), 1, 160).alias("snippet"), "r.rationale")


def sql_injection(files, symbols, routes):
    return line_findings(files, LINE_RULES[:1])


def swallowed_errors(files, symbols, routes):
    return line_findings(files, LINE_RULES[1:2])


def dangerous_calls(files, symbols, routes):
    return line_findings(files, LINE_RULES[2:])


def quality(files, symbols, routes):
    return line_findings(files, (), QUALITY)


def none_dereference(files, symbols, routes):
    """A name that a get_, find_, fetch_ or query_ call was assigned to and that is used before it is tested."""
    lines = bodies(files, symbols)
    given = lines.where(F.col("text").rlike(MAY_BE_NONE)).select("file", "symbol", "start_line", F.col("line").alias("given"), F.regexp_extract("text", MAY_BE_NONE, 1).alias("name"), F.substring(F.trim(F.regexp_extract("text", MAY_BE_NONE, 2)), 1, 100).alias("by"))
    later = given.join(lines.select("file", "symbol", "start_line", "line", "text"), ["file", "symbol", "start_line"]).where("line > given")
    guard = F.regexp_like("text", F.concat(F.lit(r"if[ \t]+(not[ \t]+)?"), "name", F.lit(r"([^A-Za-z0-9_]|$)|"), "name", F.lit(r"[ \t]+is[ \t]+(not[ \t]+)?None")))
    use = F.regexp_like("text", F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), "name", F.lit(r"(\[['\"A-Za-z0-9_]|[.][A-Za-z0-9_])")))
    event = F.when(guard, F.lit(0)).when(use, F.lit(1))
    first = later.withColumn("event", event).where("event is not null").groupBy("file", "symbol", "start_line", "given", "name", "by").agg(F.min(F.struct("line", "event", "text")).alias("x"))
    found = first.where("x.event = 1").select("file", "name", "given", "by", F.col("x.line").alias("line"), F.col("x.text").alias("text"))
    return finding(found, "unhandled_none", "HIGH", F.concat(F.lit("Possible None dereference: `"), "name", F.lit("` is used without a None check")), found=tuple(map(F.col, ("name", "by", "given", "line"))))


def _handlers(files, symbols, routes) -> DataFrame:
    """(file, symbol, start_line, signature, verb, url, texts): routes with the lines of their handlers."""
    lines = bodies(files, symbols, python=False).groupBy("file", "symbol", "start_line", "signature").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    on = routes.select("file", F.col("name").alias("symbol"), F.col("kind").alias("verb"), F.col("path").alias("url"))
    return on.join(lines, ["file", "symbol"]).withColumn("texts", F.transform("lines", lambda x: x["text"])).drop("lines")


def missing_error_handling(files, symbols, routes):
    bare = _handlers(files, symbols, routes).where(~F.exists("texts", lambda t: t.rlike(HANDLED)))
    return finding(bare, "missing_error_handling", "MEDIUM", F.concat_ws(" ", "verb", F.concat("url", F.lit(":")), F.lit("handler has no error handling")), "start_line", F.col("signature"))


def missing_input_validation(files, symbols, routes):
    rows = _handlers(files, symbols, routes)
    every = lambda pattern, group, texts: F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group)))))
    left = F.array_sort(F.array_except(every(FIELD, 2, F.col("texts")), every(QUOTED, 1, F.filter("texts", lambda t: t.rlike(VALIDATES)))))
    found = rows.withColumn("left", left).where("size(left) > 0")
    return finding(found, "missing_input_validation", "MEDIUM", F.concat_ws(" ", "verb", F.concat("url", F.lit(":")), F.lit("field(s) used without validation:"), F.concat_ws(", ", "left")), "start_line", F.col("signature"))


def queries_in_loops(files, symbols, routes):
    """The first query below a loop's head, before the body of the function goes on to the left of it."""
    lines = bodies(files, symbols)
    along = Window.partitionBy("file", "symbol", "start_line").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("text").rlike(LOOP)
    rows = lines.withColumn("head", head).withColumn("loop", F.count_if("head").over(along)).where("loop > 0")
    inside = Window.partitionBy("file", "symbol", "start_line", "loop").orderBy("line")
    rows = rows.withColumn("closed", F.max(~F.col("head") & F.col("text").rlike(LOOP_END)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.col("text").rlike(LOOP_QUERY) & ~F.col("closed")
    found = rows.withColumn("hit", hit).withColumn("before", F.coalesce(F.max("hit").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("hit and not before")
    return finding(found, "n_plus_one", "MEDIUM", "Query executed inside a loop (N+1 pattern)")


def unvalidated_rates(files, symbols, routes):
    names = F.filter(F.regexp_extract_all("signature", F.lit(PARAMETER), F.lit(1)), lambda p: p.rlike(RATE))
    rated = symbols.where("kind <> 'class'").select("file", F.col("qualified").alias("symbol"), "start_line", F.explode(F.array_distinct(names)).alias("name"))
    lines = bodies(files, symbols)
    rows = rated.join(lines, ["file", "symbol", "start_line"])
    guard = F.regexp_like("text", F.concat(F.lit(r"(^|[^A-Za-z0-9_])if[^A-Za-z0-9_](.*[^A-Za-z0-9_])?"), "name", F.lit(r"([^A-Za-z0-9_]|$)")))
    used = (F.col("line") > F.col("start_line")) & F.contains("text", "name")
    by = rows.groupBy("file", "symbol", "start_line", "signature", "name").agg(F.max(guard).alias("guarded"), F.max(used).alias("used")).where("used and not guarded")
    return finding(by, "missing_validation", "MEDIUM", F.concat(F.lit("`"), "name", F.lit("` is used without range validation")), "start_line", F.col("signature"), (F.col("name"),))


def stores_never_read(files, symbols, routes):
    found = unread(files).where("text is not null")
    via = F.when(F.col("via").isNull(), "").otherwise(F.concat(F.lit("the value actually returned is computed by `"), "via", F.lit("(...)` instead — ")))
    return finding(found, "dead_store", "MEDIUM", F.concat(F.lit("`"), "name", F.lit("` is computed but never used")), found=(F.col("name"), F.col("function"), via))


CHECKS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "sql_injection": sql_injection, "unhandled_none": none_dereference, "swallowed_error": swallowed_errors, "dangerous_call": dangerous_calls, "missing_error_handling": missing_error_handling,
    "missing_input_validation": missing_input_validation, "missing_validation": unvalidated_rates, "n_plus_one": queries_in_loops, "dead_store": stores_never_read, "quality": quality,
}


def run_checks(files: DataFrame, symbols: DataFrame, routes: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Findings of all checks, or of those named; all rules of lines share one pass."""
    wanted = lambda name: not categories or name in categories
    rules, first_of = [r for r in LINE_RULES if wanted(r[0])], QUALITY if wanted("quality") else ()
    found = [line_findings(files, rules, first_of)] if rules or first_of else []
    rest = {name: check for name, check in CHECKS.items() if wanted(name) and name not in (*[r[0] for r in LINE_RULES], "quality")}
    own = files
    if "body_lines" in symbols.columns and rest.keys() - {"dead_store"}:
        own, symbols = None, written(symbols.join(files.select(F.col("path").alias("file")), "file", "left_semi"))
    found += [check(files if name == "dead_store" else own, symbols, routes) for name, check in rest.items()]
    return reduce(DataFrame.unionByName, found)
