"""Evaluation rules and report files; hashed vectors with planted collisions."""

import json
import math
import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import evaluate as E
from lodestrand.operators import retrieval as R

ROWS = [
    {"id": "q1", "category": "code_search", "task": "search", "question": "where", "expected_files": ["a.py", "b.py"], "expect_keywords": ["Token"]},
    {"id": "q2", "category": "pr_review", "task": "review", "diff": "x", "expected_findings": ["sql", "none"]},
    {"id": "q3", "category": "test_generation", "task": "testgen", "expect_verification": ["passed", "fixed"]},
    {"id": "q4", "category": "code_search", "task": "search"},
]
GIVEN = [  # id, results, retrieved, cited, answer, findings, verification, total, latency_ms
    ("q1", ["search"], ["x", "a.py", "c", "d", "e", "b.py"], ["a.py", "x"], "the TOKEN is in b.py", [], None, None, 10.0),
    ("q2", ["review"], [], [], None, ["none", "sql", "todo"], None, None, 30.0),
    ("q3", ["testgen"], [], [], "", [], "fixed", 3, 20.0),
    ("q4", [], ["a"], ["a"], "", [], None, None, 40.0),
]


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("questions")
    (at / "a.json").write_text("\n".join(map(json.dumps, ROWS)))
    given = spark.createDataFrame(GIVEN, "id string, results array<string>, retrieved array<string>, cited array<string>, answer string, findings array<string>, verification string, total int, latency_ms double")
    return str(at), E.marked(E.questions(spark, str(at)).join(given, "id")).cache()


def test_questions_by_category_and_limit(spark, answers):
    assert [r.id for r in E.questions(spark, answers[0], ["code_search"], 1).collect()] == ["q1"]
    assert E.questions(spark, answers[0]).where("expected_files is null").isEmpty()


def test_marks(answers):
    got = {r.id: (r.success, r.route_ok, r.recall_5, r.recall_10, r.citation) for r in answers[1].collect()}
    assert got == {"q1": (True, True, 0.5, 1.0, 0.5), "q2": (True, True, None, None, None), "q3": (True, True, None, None, None), "q4": (False, False, None, None, None)}
    worse = answers[1].withColumn("findings", F.array(F.lit("sql"))).withColumn("total", F.lit(0)).withColumn("answer", F.lit("token"))
    assert {r.id: r.success for r in E.marked(worse).collect()} == {"q1": False, "q2": False, "q3": False, "q4": False}


def test_report(spark, answers, tmp_path):
    E.write_report(answers[1], str(tmp_path))
    one = spark.read.json(f"{tmp_path}/summary.json").collect()[0]
    assert (one.questions, one.success, one.latency_p50, one.latency_p95, one.recall_5) == (4, 0.75, 25.0, 40.0, 0.5)
    parts = sorted(f for f in os.listdir(f"{tmp_path}/results.md") if f.startswith("part"))
    lines = "".join((tmp_path / "results.md" / f).read_text() for f in parts).splitlines()
    assert lines[2] == "Questions: **4**" and lines[7] == "Latency p50 / p95: **25.0 ms / 40.0 ms**" and "| code_search | 2 | 0.5 | 0.5 |" in lines
    assert lines[-4:] == ["| q1 | code_search | ✅ | 0.5 | 10.0 |", "| q2 | pr_review | ✅ | None | 30.0 |", "| q3 | test_generation | ✅ | None | 20.0 |", "| q4 | code_search | ❌ | None | 40.0 |"]
    assert spark.read.json(f"{tmp_path}/results.json").count() == 4


def test_hashed_vectors_with_collisions(spark, monkeypatch):
    monkeypatch.setattr(R, "WIDTH", 3)
    texts = {1: {"red": 2, "blue": 1, "green": 4, "white": 3, "black": 1}, 2: {"red": 1}, 3: {"cyan": 3, "blue": 2}, 4: {"pink": 1, "grey": 1, "teal": 9}}
    asked = {1: {"red": 1, "teal": 1}, 2: {"unheard": 2}}
    place = lambda t: zlib.crc32(t.encode()) % 3
    frame = lambda bags, key: spark.createDataFrame([(k, t, n) for k, bag in bags.items() for t, n in bag.items()], f"{key} long, term string, n long")
    total = spark.createDataFrame([(len(texts),)], "n_docs long")
    tf, weights = R.bucket_weights(frame(texts, "doc_id"), total, "doc_id")
    items = R.bucket_vectors(tf, weights, total, "doc_id")
    queries = R.bucket_vectors(R.bucket_weights(frame(asked, "query_id"), total, "query_id")[0], weights, total, "query_id")

    df = defaultdict(int)
    for bag in texts.values():
        for b in {place(t) for t in bag}:
            df[b] += 1

    def vector(bag):
        out = defaultdict(float)
        for t, n in bag.items():
            out[place(t)] += 1 + math.log(n)
        out = {b: w * (math.log((len(texts) + 1) / (df[b] + 1)) + 1) for b, w in out.items()}
        norm = math.sqrt(sum(w * w for w in out.values()))
        return norm, {b: w / norm for b, w in out.items()}

    assert any(len({place(t) for t in bag}) < len(bag) for bag in texts.values())  # some features share a bucket
    for r in items.collect():
        norm, want = vector(texts[r.doc_id])
        assert abs(r.norm - norm) < 1e-9 and r.buckets == sorted(want) and all(abs(w - want[b]) < 1e-9 for b, w in zip(r.buckets, r.weights))
    got = {(r.query_id, r.doc_id): r.score for r in R.bucket_top_k(items, queries, 10, query_block=1, item_block=2).collect()}
    want = {(q, d): round(sum(w * vector(texts[d])[1].get(b, 0) for b, w in vector(asked[q])[1].items()), 6) for q in asked for d in texts}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_markers_are_looked_for_by_words_that_their_patterns_need():
    """A pattern is tried only on texts with one of its words, so each of its alternatives has to hold one."""
    import re

    from lodestrand.operators import planner as P

    for _, name, pattern in P.MARKERS:
        plain = re.sub(r"\[(.)\]", r"\1", pattern.replace(P._W, "").replace(P._E, "")).replace('\\"', '"')
        parts = re.split(r"[|](?![^(]*[)])", plain)
        assert parts and all(any(w in part for w in P.MARKED[name]) for part in parts), (name, parts)


def test_summary_reads_whole_texts_in_one_pass(spark):
    from lodestrand.operators import planner as P

    said = "x = 1\n" * 3000
    files = spark.createDataFrame([("app/a.py", "python", f"import fastapi\n{said}"), ("app/b.py", "python", "nofastapi = 1"), ("docs/c.md", "markdown", "import fastapi"), ("tests/test_a.py", "python", "")], "path string, language string, content string")
    got = {(r.aspect, r.value): r.n for r in P.summary(files).collect()}
    assert got[("framework", "FastAPI")] == 1 and got[("size", "files")] == 4 and got[("size", "lines")] == 3004 and got[("size", "tests")] == 1


def test_names_are_told_without_the_unparser():
    import ast

    from lodestrand.operators.code import _dotted

    for text in ("a", "a.b.c", "a().b", "a[0].b", "'x'.join", "(a + b).c", "self.x.y"):
        node = ast.parse(text, mode="eval").body
        assert _dotted(node) == ast.unparse(node)
