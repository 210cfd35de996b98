"""Containment, closures and percentiles against plain loops, and what their plans avoid."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import graph, sequences
from lodestrand.operators.containment import containing


def test_containment(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab/c", k=rng.randrange(9))) for _ in range(120)] + ["", "é日本", "日本", "abc"]
    needles, hays = texts[::2] + ["", "a", "日"], texts
    one, other = (spark.createDataFrame([(t,) for t in x], f"{n} string") for x, n in ((needles, "needle"), (hays, "hay")))
    met = containing(one, other)
    assert {tuple(r) for r in met.collect()} == {(n, h) for n in needles for h in hays if n in h} and met.count() == met.distinct().count()
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()
    assert containing(one.limit(0), other).count() == 0 == containing(one, other.limit(0)).count()


def plain_closure(edges, starts):
    out = set()
    for s in starts:
        seen, todo = set(), [s]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        out |= {(s, n) for n in seen}
    return out


def test_closure_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)}
        starts = list(range(0, 25, 2)) + [99]
        got = graph.closure(spark.createDataFrame(list(edges), "src int, dst int"), spark.createDataFrame([(s,) for s in starts], "start int"))
        assert {tuple(r) for r in got.collect()} == plain_closure(edges, starts) and got.count() == got.distinct().count()


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written, rounds = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or written(df))
    chain = spark.range(600).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.closure(chain, spark.range(3).select(F.col("id").alias("start")))
    assert got.count() == 600 + 599 + 598 and len(rounds) <= 2 + 3 * 11


@pytest.mark.parametrize("few", [1, 3, 10_000])
def test_percentiles(spark, few):
    rng = random.Random(few)
    rows = [(k, v) for k, n in (("a", 500), ("b", 7), ("c", 1), ("d", 40)) for v in ([rng.lognormvariate(0, 9) for _ in range(n)] if k != "d" else [5.0] * 39 + [-1e300])] + [("a", None), ("e", None)]
    data = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for key in "abcd":
            values = sorted(v for k, v in rows if k == key and v is not None)
            want[key] = values[round(share * (len(values) - 1))]
        assert {r.k: r.value for r in sequences.rank_percentile(data, "k", "v", share, few).collect()} == want


def test_pruned_search_gives_the_same_rows_from_fewer_pairs(spark, monkeypatch):
    from lodestrand.operators import retrieval as R

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = spark.createDataFrame([(d, " ".join(rng.choices(words, weights, k=60))) for d in range(1500)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, weights, k=6) + rng.choices(words[150:], k=3))) for q in range(12)] + [(50, "w0 w1"), (51, "unknown")], "query_id long, text string")
    counts, total = R.term_counts(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = R.idf(counts, total)
    index, queries = R.written(R.vectors(counts, idf, "doc_id")), R.written(R.query_vectors(R.term_counts(asked, "query_id", "text"), idf, total))
    made, written = [], R.written
    monkeypatch.setattr(R, "written", lambda df: made.append(written(df)) or made[-1])
    for k in (1, 10):
        want = {tuple(r) for r in R.search(index, queries, k).select("query_id", "doc_id", "score", "rank").collect()}
        assert {tuple(r) for r in R.pruned_search(index, queries, 1500, k).select("query_id", "doc_id", "score", "rank").collect()} == want
    pairs = queries.join(index, "term").select("query_id", "doc_id").distinct().count()
    assert made[3].count() < pairs / 2  # candidates of k = 1
