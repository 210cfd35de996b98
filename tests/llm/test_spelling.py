"""Spelling variants against plain loops."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestrand.llm import common, spelling_sql, spelling_variants

STEMS = ["harmonic", "harmonica", "parallel", "serendipity", "ÀÉÎcolour", "straße", "naïvetés", "zoologist", "embarrass", "a" * 90, "×÷letters"]


def texts():
    rng = np.random.default_rng(4)
    out = [None, "", " 12 ", "Ünïcode " * 3, "STRASSE straßenbahn " * 4]
    for i in range(60):
        words = []
        for stem in rng.choice(STEMS, 40):
            if rng.random() < 0.25:
                k = rng.integers(len(stem))
                stem = stem[:k] + rng.choice(["", "x", "é", stem[k] * 2]) + stem[k + 1 :]
            words.append(stem.upper() if rng.random() < 0.1 else str(stem))
        out.append(rng.choice([" ", ", ", "\n", "1"]).join(words))
    return out


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if v != w and one_edit(v, w)]
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


@pytest.fixture(scope="module")
def rows():
    found = [*enumerate(texts()), (None, "harmonic " * 3), (7, texts()[7]), (7, texts()[7])]
    return found


@pytest.mark.parametrize("block_words, slice_bytes", [(8192, 4 << 20), (3, 50)])
def test_variants(spark, rows, block_words, slice_bytes, monkeypatch):
    monkeypatch.setattr(spelling_variants, "near_words", lambda words, f=spelling_variants.near_words: f(words, block_words))
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {tuple(r) for r in spelling_variants.variants(docs).collect()}
    want = plain(rows)
    assert got == want and sum(r[3] is not None for r in want) > 5
    assert spelling_variants.variants(docs.limit(0)).count() == 0


def test_sql_on_the_same_rows(rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    assert set(db.execute(spelling_sql.SQL).fetchall()) == plain(rows)


def test_slices_keep_runs_whole():
    texts = pa.array([None, "abc def", "x" * 30 + " " + "y" * 30, "", "ab cd " * 40])
    for most in (5, 20, 1000):
        joined = {}
        for which, part in common.text_slices(texts, "[^a-z]", most):
            for i, t in zip(which, part.to_pylist()):
                joined.setdefault(i, []).append(t)
        assert {i: "".join(p) for i, p in joined.items()} == {i: t or "" for i, t in enumerate(texts.to_pylist())}
        assert all(re.search("[^a-z]$", p) for parts in joined.values() for p in parts[:-1])


def test_checksums_of_joined_texts():
    words = ["", "a", "é" * 10, "b" * 63, "c" * 64, "d" * 65, "e" * 3000]
    which = np.arange(len(words))
    for prefix in (b"", b"12:", b"x" * 99):
        got = spelling_variants.checksums(np.full(len(words), zlib.crc32(prefix), np.uint32), words, which)
        assert got.tolist() == [zlib.crc32(prefix + w.encode()) for w in words]


def test_tile_of_anagrams_and_chains():
    words = ["abcdefg", "bacdefg", "abcdefh", "abcdefgh", "bcdefgh", "xxxxxxx", "abcdef", "aabcdefg"]
    for a in (6, 7, 8):
        for b in (a, a + 1):
            left, right = [w for w in words if len(w) == a], [w for w in words if len(w) == b]
            tile = left if a == b else left + right
            if not left or not right:
                continue
            role = np.array([2] * len(left) if a == b else [0] * len(left) + [1] * len(right))
            found = spelling_variants.near_in_tile(tile, np.arange(1, len(tile) + 1), role)
            want = {w: sum(one_edit(w, v) for v in tile if v != w and (a == b or len(v) != len(w))) for w in tile}
            assert dict(zip(found["word"], found["n_near"])) == {w: n for w, n in want.items() if n}
