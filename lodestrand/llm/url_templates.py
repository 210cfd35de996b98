"""URL filter: a path-template tree for each host.

The paths of each host are read as a tree of segments, level by level.  At each node
 - segments that are rare among the node's pages (numbers, slugs, dates) become one wildcard, which keeps
   the file extension;
 - branches that can't be told apart statistically are merged: those whose labelled share of bad pages is within two
   standard errors of the node's, to which those without any labels belong, so they are judged as the node is.
A node of fewer than LEAST_PAGES pages has no branches: what follows is ``**``.  So levels are added until each path has
come to its end or to such a node; a long path alone makes none.
What remains are templates.  A template is rejected if it has enough labelled pages and the share of bad ones,
smoothed towards the share over all hosts, is high.

Labels come from rules: a rule (host, path) judges a url outright if the host is the rule's or below it and
the path begins with the rule's; the longest rule that fits wins.  Pages that no rule judges get their
template's verdict.

Everything is counted from distinct (host, path) pairs with numbers of pages, so a host with a third of all
pages is aggregated on the map side before any shuffle, and no node's children meet in one task.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed unless its
template (all such urls share one) is rejected; a very long url is read to its end; null ids and repeated rows are judged
one by one; an empty table gives an empty result; columns of the input beyond the id and the url aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import LOWER, UPPER, stored

#: A segment is kept if it has at least so many pages and one in RARE of its node's.
LEAST_PAGES, RARE = 5, 20
#: Labelled pages that a rejected template needs; weight of the overall share; least share in percent.
LEAST_LABELS, PRIOR_WEIGHT, REJECT_PERCENT = 5, 4, 80


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _level(paths: DataFrame, depth: int) -> DataFrame:
    """Append each path's branch at this depth to its template."""
    segment = F.when(F.size("segments") > depth, F.col("segments")[depth])
    now = paths.withColumn("segment", segment)
    going = F.col("segment").isNotNull() & ~F.col("closed")
    ended, active = now.where(~going).drop("segment"), now.where(going)
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    children = active.groupBy(*node, "segment").agg(*sums)
    sizes = children.groupBy(*node).agg(F.sum("n").alias("node_n"))
    rare = (F.col("n") < LEAST_PAGES) | (F.col("n") * RARE < F.col("node_n"))
    wild = F.concat(F.lit("*"), F.regexp_extract("segment", r"\.[A-Za-z]+$", 0))
    children = children.join(sizes, node).withColumn("branch", F.when(rare & (F.col("segment") != ""), wild).otherwise(F.col("segment")))
    branches = children.groupBy(*node, "branch").agg(*sums)
    pool = branches.groupBy(*node).agg(F.sum("labelled").cast("double").alias("all_l"), F.sum("bad").cast("double").alias("all_b"))
    lab, bad, all_l, all_b = F.col("labelled").cast("double"), F.col("bad").cast("double"), F.col("all_l"), F.col("all_b")
    near = F.pow((bad * all_l - all_b * lab) * (all_l + 2), F.lit(2)) <= 4 * (all_b + 1) * (all_l - all_b + 1) * lab * all_l * all_l
    kinds = branches.join(pool, node).withColumn("kind", F.when(near, "alike").otherwise(F.concat(F.lit("own "), "branch")))
    merged = kinds.groupBy(*node, "kind").agg(F.count(F.lit(1)).alias("members"))
    named = kinds.join(merged, [*node, "kind"]).withColumn("merged", F.when((F.col("members") > 1) & (F.col("kind") == "alike"), "(alike)").otherwise(F.col("branch")))
    few = F.col("node_n") < LEAST_PAGES
    names = children.select(*node, "segment", "branch", few.alias("few")).join(named.select(*node, "branch", "merged"), [*node, "branch"]).select(*node, "segment", "few", F.when(F.col("few"), "**").otherwise(F.col("merged")).alias("merged"))
    grown = active.join(names, [*node, "segment"]).withColumns({"template": F.concat("template", F.lit("/"), "merged"), "closed": F.col("few")}).select(ended.columns)
    return stored(ended.unionByName(grown))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(``page_id``, host, path, rule, verdict, template) for every page; rules: (host, path, ``allow`` or ``block``)."""
    host, path = host_and_path(F.col(f"`{url}`"))
    read = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    name, says = _ruled(F.col("host"), F.col("path"), rules)
    counted = read.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("says", says)
    known = F.col("says").isNotNull()
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    paths = stored(
        counted.select(
            "host", "path", "n", F.when(known, F.col("n")).otherwise(0).alias("labelled"), F.when(F.col("says") == "block", F.col("n")).otherwise(0).alias("bad"),
            parts.alias("segments"), F.lit("").alias("template"), F.lit(False).alias("closed"),
        )
    )
    level = 0
    while not paths.where(~F.col("closed") & (F.size("segments") > level)).isEmpty():
        paths = _level(paths, level)
        level += 1
    templates = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = paths.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("all_l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("all_b")).first()
    # (bad + PRIOR_WEIGHT * all_b / all_l) / (labelled + PRIOR_WEIGHT) >= REJECT_PERCENT / 100, in whole numbers
    pure = 100 * (F.col("bad") * total.all_l + PRIOR_WEIGHT * total.all_b) >= REJECT_PERCENT * (F.col("labelled") + PRIOR_WEIGHT) * total.all_l
    rejected = templates.where((F.col("labelled") >= LEAST_LABELS) & pure).select("host", "template", F.lit(True).alias("rejected"))
    by_path = paths.select("host", "path", "template").join(rejected, ["host", "template"], "left")
    out = read.join(by_path, ["host", "path"]).withColumns({"rule": name, "says": says})
    verdict = F.coalesce("says", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(F.col("page_id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"), "template")
