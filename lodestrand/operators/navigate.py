"""Questions to the code graph: symbols, routes, traces, tests, callers, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import graph
from lodestrand.operators.containment import containing
from lodestrand.operators.rules import first_wins


def is_test(path: str, loose: bool = False):
    """Base name begins with test_ (or test. if ``loose``), or a folder of tests."""
    base = F.substring_index(path, "/", -1)
    named = base.startswith("test_") | (base.startswith("test.") if loose else F.lit(False))
    return named | F.concat(F.lit("/"), path).contains("/tests/") | F.col(path).contains("__tests__")


def find_symbols(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file, qualified, start_line): symbols that a name (column name) means, exactly or else in any case."""
    known = symbols.select("file", "qualified", "start_line", F.explode(F.array_distinct(F.array("name", "qualified"))).alias("key"))
    wanted = names.select(F.trim("name").alias("name")).distinct()
    exact = wanted.join(known, F.col("name") == F.col("key")).withColumn("prio", F.lit(0))
    loose = wanted.join(known, F.lower("name") == F.lower("key")).withColumn("prio", F.lit(1))
    best = Window.partitionBy("name")
    both = exact.unionByName(loose).withColumn("least", F.min("prio").over(best)).where("prio = least")
    return both.select("name", "file", "qualified", "start_line").distinct()


def find_routes(routes: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint_id, verb, path, file, handler): the route that a hint (hint_id, hint, verb or null) means.

    The path itself but for a slash at its end; else paths that hold the hint or lie in it, the longest first.  Of these
    the first with the verb, or the first.  Distinct hints meet distinct paths, and of each path the first route of each verb.
    """
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    asked = hints.select("hint_id", strip(F.trim("hint")).alias("hint"), F.coalesce(F.upper("verb"), F.lit("")).alias("wanted"))
    # of routes with one path and verb only the first can be meant
    known = first_wins(routes.select("path", "file", F.col("kind").alias("verb"), F.col("name").alias("handler"), "start_line"), ["path", "verb"], "file", "start_line", "handler")
    paths, words = routes.select("path").distinct(), asked.select("hint").distinct()
    inside = containing(words.select(F.col("hint").alias("needle")), paths.select(F.col("path").alias("hay"))).select(F.col("needle").alias("hint"), F.col("hay").alias("path"))
    around = containing(paths.select(F.col("path").alias("needle")), words.select(F.col("hint").alias("hay"))).select(F.col("hay").alias("hint"), F.col("needle").alias("path"))
    same = words.join(paths.withColumn("hint", strip(F.col("path"))), "hint")
    met = inside.unionByName(around).unionByName(same.select("hint", "path")).distinct()
    met = met.withColumn("exact", (F.col("path") == F.col("hint")) | (strip(F.col("path")) == F.col("hint")))
    met = met.withColumn("any", F.max("exact").over(Window.partitionBy("hint"))).where("exact or not any")
    every = asked.select("hint", "wanted").distinct().join(met, "hint").join(known, "path")
    length = F.when(F.col("exact"), 0).otherwise(F.length("path"))
    best = first_wins(every, ["hint", "wanted"], F.desc(F.col("wanted") == F.col("verb")), F.desc(length), "file", "start_line")
    return asked.join(best, ["hint", "wanted"]).select("hint_id", "verb", "path", "file", "handler")


def trace_routes(routes: DataFrame, calls: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """(trace, ord, depth, file, symbol, line, signature): what each route's handler calls, in the order of a breadth-first walk."""
    node = lambda file, name: F.struct(F.col(file).alias("file"), F.col(name).alias("symbol"))
    edges = calls.select(node("caller_file", "caller").alias("src"), node("callee_file", "callee").alias("dst"))
    walked = graph.ordered_trace(edges, routes.select("trace", node("file", "handler").alias("node")), depth)
    rows = walked.select("trace", "ord", "depth", "node.file", "node.symbol")
    where = symbols.select("file", F.col("qualified").alias("symbol"), F.col("start_line").alias("at"), "signature")
    return rows.join(where, ["file", "symbol"], "left").select("trace", "ord", "depth", "file", "symbol", F.coalesce("at", F.lit(0)).alias("line"), F.coalesce("signature", F.lit("")).alias("signature"))


def tests_of(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, test): test files that import a file or name one of its symbols of more than four characters, but itself.

    Names are looked for inside identifiers of the tests, cut to the lengths that names have, by an equality join.
    """
    tests = files.where(is_test("path"))
    by_import = imports.where("resolved is not null").select(F.col("resolved").alias("path"), F.col("file").alias("test")).join(tests.select(F.col("path").alias("test")), "test", "left_semi")
    names = symbols.where("length(name) > 4").select(F.col("file").alias("path"), "name").distinct()
    lengths = sorted(r.n for r in names.select(F.length("name").alias("n")).distinct().collect())  # a few numbers
    runs = tests.select(F.col("path").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]{5,}"), F.lit(0)))).alias("run"))
    none = F.array().cast("array<string>")

    def cut(n: int):
        at = F.sequence(F.lit(1), F.greatest(F.length("run") - n + 1, F.lit(1)))
        return F.when(F.length("run") >= n, F.transform(at, lambda i: F.substring("run", i, F.lit(n)))).otherwise(none)

    parts = F.flatten(F.array(*[cut(n) for n in lengths] or [none]))
    said = runs.select("test", F.explode(parts).alias("name")).distinct().join(names, "name").select("path", "test")
    return by_import.unionByName(said.select("path", "test")).where("path <> test").distinct()


def direct_neighbours(edges: DataFrame, most: int = 6) -> DataFrame:
    """(path, direction, other, rank): at most ``most`` dependencies and dependents of each file, in order."""
    both = edges.select(F.col("src").alias("path"), F.lit("dependency").alias("direction"), F.col("dst").alias("other")).union(edges.select("dst", F.lit("dependent"), "src"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("path", "direction").orderBy("other"))).where(F.col("rank") <= most)


def callers_of(calls: DataFrame, most: int = 2) -> DataFrame:
    """(callee_file, callee, caller_file, caller, rank): the first callers of each symbol outside of tests."""
    rows = calls.where(~is_test("caller_file"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("callee_file", "callee").orderBy("caller_file", "caller"))).where(F.col("rank") <= most)


def file_summaries(files: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """(path, summary): a file with its first symbols and their kinds."""
    ranked = symbols.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("start_line"))).where(F.col("rn") <= most)
    listed = ranked.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("rn", "kind", "qualified"))).alias("x"))
    said = F.array_join(F.transform("x", lambda s: F.concat_ws(" ", s["kind"], s["qualified"])), ", ")
    return files.select("path").join(listed, "path", "left").select("path", F.when(F.col("x").isNotNull(), F.concat("path", F.lit(": "), said)).otherwise(F.col("path")).alias("summary"))
