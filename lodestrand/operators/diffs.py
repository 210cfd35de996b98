"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import split_lines


def parse(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, path, op, line, text, hunk, seq): added and removed lines with their line numbers in the new file.

    ``+++ [b/]path`` opens a file, a hunk header sets the counter, ``---`` lines are skipped, and every line that isn't
    removed moves the counter on.
    """
    rows = diffs.select(key, F.posexplode(split_lines(F.col(text))).alias("seq", "raw"))
    whole = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("raw").startswith("+++ ")
    hunk_start = F.when(F.col("raw").startswith("@@"), F.regexp_extract("raw", r"\+([0-9]+)", 1).cast("int"))
    rows = rows.withColumn("opens", F.when(header, F.regexp_replace("raw", r"^\+\+\+ (b/)?", ""))).withColumn("begins", hunk_start)
    rows = rows.withColumn("path", F.last("opens", ignorenulls=True).over(whole)).withColumn("hunk", F.count("begins").over(whole)).withColumn("start", F.last("begins", ignorenulls=True).over(whole))
    body = rows.where(F.col("opens").isNull() & F.col("begins").isNull() & ~F.col("raw").startswith("---") & F.col("path").isNotNull() & (F.col("hunk") > 0))
    inside = Window.partitionBy(key, "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.when(F.col("raw").startswith("-"), 0).otherwise(1)).over(inside), F.lit(0))
    out = body.withColumn("line", (F.col("start") + moved).cast("int")).withColumn("op", F.substring("raw", 1, 1)).where("op in ('+', '-')")
    return out.select(key, "path", "op", "line", F.expr("substring(raw, 2)").alias("text"), "hunk", "seq")


def lost_parameters(rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """Functions whose signature lost parameters: (key, path, name, lost)."""
    defs = rows.where(F.col("text").rlike(r"^\s*def [A-Za-z_]")).select(key, "path", "op", F.regexp_extract("text", r"def ([A-Za-z_0-9]+)", 1).alias("name"), F.regexp_extract("text", r"\(([^)]*)\)", 1).alias("inner"))
    params = F.filter(F.transform(F.split("inner", ","), lambda p: F.trim(F.regexp_replace(p, "[:=].*$", ""))), lambda p: p != "")
    defs = defs.withColumn("params", params)
    old, new = defs.where("op = '-'").select(key, "path", "name", F.col("params").alias("old")), defs.where("op = '+'").select(key, "path", "name", F.col("params").alias("new"))
    return old.join(new, [key, "path", "name"]).withColumn("lost", F.array_except("old", "new")).where("size(lost) > 0").select(key, "path", "name", "lost")
