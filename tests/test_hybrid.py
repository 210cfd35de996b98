"""The hybrid search against scores of all pairs, written out one by one."""

import math
from collections import Counter

import pytest

from lodestrand.operators import chunks as C
from lodestrand.operators import hybrid as H
from lodestrand.operators import retrieval as R

QUESTIONS = [(i, f"where is load_{i} created or validated in mod {i} for POST /items/{i % 4}0" if i % 3 else f"who calls run {i} nowhereword{i}") for i in range(1, 60)] + [(90, ""), (91, "go")]
CHUNKS = [
    (f"c{i:03d}", f"c{i:03d}", ("symbol", "file", "route", "doc")[i % 4], f"app/pkg{i % 5}/mod_{i}.py", (f"create_{i}" if i % 3 else f"Box.load_{i}") if i % 4 in (0, 2) else None, ("load_%d items mod POST create " % (i % 61)) + ("token created where validated " * (i % 3)) + "filler%d " % i * (i % 7 + 1))
    for i in range(300)
] + [("zz1", "zz1", "doc", "x.md", None, None), ("c300", "c300", "doc", "docs/go.md", None, "nothing at all here")]
ROUTED = [(i, f"app/pkg{(4 * i + 2) % 300 % 5}/mod_{(4 * i + 2) % 300}.py", f"create_{(4 * i + 2) % 300}" if (4 * i + 2) % 300 % 3 else f"Box.load_{(4 * i + 2) % 300}") for i in range(1, 60, 7)]


def _bag(text):
    words = Counter(H.words_of(text.encode()) if text else [])
    out = Counter({f"w:{w}": n for w, n in words.items()})
    for w, n in words.items():
        for k in range(len(w)):
            out[f"g:{f'^{w}$'[k : k + 3]}"] += n
    return out


def _plain(k, kinds, most):
    bags = {c[0]: _bag(c[5]) for c in CHUNKS}
    df = Counter(t for b in bags.values() for t in b)
    idf = lambda t: math.log((len(CHUNKS) + 1) / (df[t] + 1)) + 1

    def unit(bag):
        raw = {t: (1 + math.log(n)) * idf(t) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    vectors, routed, out = {c: unit(b) for c, b in bags.items()}, {r[0]: r[1:] for r in ROUTED}, {}
    for q, text in QUESTIONS:
        asked = unit(_bag(text))
        words = {t[2:] for t in asked if t[:2] == "w:"}
        dots = {c: round(sum(w * v.get(t, 0) for t, w in asked.items()), 6) for c, v in vectors.items() if asked.keys() & v.keys()}
        near = dict(sorted(dots.items(), key=lambda x: (-x[1], x[0]))[: max(3 * k, 24)])
        rows = []
        for chunk, _, kind, file, symbol, _ in CHUNKS:
            kw = len(words & {t[2:] for t in bags[chunk] if t[:2] == "w:"}) / (math.sqrt(len(words)) + 1e-9)
            bare = (symbol or "").rsplit(".", 1)[-1].lower()
            sym = 0.35 if bare in words else 0.3 if bare and any(bare.split("_")[0] in C.VERBS[w] for w in words if w in C.VERBS) else 0
            path = sum(len(w) > 2 and w in file.lower() for w in words)
            boost = 0.6 if kind == "route" and routed.get(q) == (file, symbol) else 0
            score = round((0.55 * near.get(chunk, 0) + 0.45 * min(kw, 1) + 0.08 * path + sym + boost) * (0.85 if kind == "file" else 1), 6)
            if score > 0.02 and (not kinds or kind in kinds):
                rows.append((-score, chunk))
        out |= {(q, i + 1): (c, -s) for i, (s, c) in enumerate(sorted(rows)[:most])}
    return out


@pytest.mark.parametrize(("kinds", "most", "small"), [((), 10, False), (("symbol",), 5, True)])
def test_best_chunks_are_those_of_all_pairs(spark, monkeypatch, kinds, most, small):
    if small:  # many blocks, most words joined instead of sent
        for name, value in (("QUESTIONS", 16), ("CHUNKS", 40), ("SENT", 3), ("OPEN", 2), ("MOST", 3)):
            monkeypatch.setattr(H, name, value)
    rows = spark.createDataFrame(CHUNKS, "chunk string, id string, kind string, file string, symbol string, text string")
    best, score = C.best_chunks(rows, spark.createDataFrame(QUESTIONS, "query_id long, text string"), spark.createDataFrame(ROUTED, "query_id long, file string, handler string"), 10, kinds, most)
    got, want = {(r.query_id, r.rank): (r.chunk, r.score) for r in best.collect()}, _plain(10, kinds, most)
    assert got.keys() == want.keys() and len(want) > 200
    wrong = {k: (got[k], want[k]) for k in want if got[k][0] != want[k][0] or abs(got[k][1] - want[k][1]) > 2e-6}
    assert not wrong
    if not small:  # any pair has the score it has among the best
        again = {(r.query_id, r.chunk): r.score for r in score(best.select("query_id", "chunk").where("rank = 2")).collect()}
        assert again == {(q, c): s for (q, k), (c, s) in got.items() if k == 2}


def test_words_are_those_of_tokens(spark):
    from pyspark.sql import functions as F

    from lodestrand.functions.text import tokens

    texts = ["Load_items 12ab a_b is_the classes gas class9s __x__ ÄbcDef x1 7", "", "the THIS runs_2 bass boss goes", "é_ab 007_abc", "\u212aelvin \u0130ab 12_34ab __9z 5a_"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [H.words_of(t.encode()) for t in texts] and H.words_of(None) == []


def test_rules_of_lines_are_tried_only_where_their_words_stand(spark):
    """Lines that fit without blanks, with tabs or in other cases are found; parsed functions bring their lines along."""
    from lodestrand.operators import code, detect

    text = "def f(a, b={}):\n    if a ==None or b !=\tNone:\n        CURSOR.run( F'x')\n    total = 0\r    total += a\r\n    Execute(f\"x\")\n    x = f'DELETE {a}'\n    exec (a)\n    # hack\x0c    # XXX\n"
    files = spark.createDataFrame([("a.py", "python", text)], "path string, language string, content string")
    symbols = code.symbols(code.parse_python(files))
    got = {(r.line, r.category) for r in detect.line_findings(files, detect.LINE_RULES, detect.QUALITY).collect()}
    assert got == {(1, "mutable_default"), (2, "style"), (3, "sql_injection"), (6, "sql_injection"), (7, "sql_injection"), (8, "dangerous_call"), (10, "todo")}
    by_text = detect.bodies(files, symbols.drop("body_lines")).collect()
    assert sorted(map(tuple, by_text)) == sorted(map(tuple, detect.bodies(files, symbols).collect())) == sorted(map(tuple, detect.bodies(None, symbols).collect())) and len(by_text) >= 8
    assert not detect.bodies(files.where("path = 'b.py'"), symbols).collect()
    assert [(r.line, r.text) for r in code.unread(files).collect()] == [(5, "    total += a")]


def test_bags_and_hashed_vectors_need_no_shuffle_of_terms(spark):
    """As the general operators count and weight, rows of equal keys and texts without words included."""
    from pyspark.sql import functions as F

    texts = [(1, "red reds blue_red 12"), (2, None), (3, "the of"), (4, "green green greens ab"), (4, "blue\nlast"), (5, "ab")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    counts = C.features(rows, "doc_id", "text")
    want = counts.groupBy("doc_id").agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).collect()
    got = H.feature_sizes(rows, "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 3
    assert "hashpartitioning(term" not in got._jdf.queryExecution().toString()
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    tf, weights = R.bucket_weights(counts, total, "doc_id")
    plain = {r.doc_id: r for r in R.bucket_vectors(tf, weights, total, "doc_id").collect()}
    items, alike = H.hashed_vectors(rows, "doc_id", "text")
    for r in items.collect():
        w = plain.pop(r.doc_id)
        assert list(r.buckets) == list(w.buckets) and r.norm == pytest.approx(w.norm) and list(r.weights) == pytest.approx(list(w.weights))
    assert not plain
    asked = alike(spark.createDataFrame([(7, "blue zebra")], "query_id long, text string"), "query_id", "text")
    assert {(r.query_id, r.doc_id) for r in R.bucket_top_k(items, asked, 2, item_block=1).collect() if r.score > 0.1} == {(7, 1), (7, 4)}


def test_routes_of_one_path_meet_hints_once(spark):
    from lodestrand.operators import navigate as N

    routes = spark.createDataFrame([(f"f{i:02d}.py", f"h{i}", "POST" if i % 2 else "GET", "/a/b", 5) for i in range(40)], "file string, name string, kind string, path string, start_line int")
    found = N.find_routes(routes, spark.createDataFrame([(i, "/a/b/", ("post", "get", None)[i % 3]) for i in range(50)], "hint_id long, hint string, verb string"))
    assert {(r.hint_id % 3, r.verb, r.file) for r in found.collect()} == {(0, "POST", "f01.py"), (1, "GET", "f00.py"), (2, "GET", "f00.py")} and found.count() == 50
