import random

import numpy as np

from lodestrand.llm import tiling as G


def brute(doc, item, least):
    """Mark the longest free common run again and again."""
    d, m, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not m[i + k] and not d[j + k]:
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return sorted(out)
        k, i, j = -best[0], best[1], best[2]
        m[i : i + k] = d[j : j + k] = [True] * k
        out.append((j, i, k))


def test_tiles_equal_the_greedy_choice():
    rng = random.Random(5)
    for _ in range(300):
        words = rng.choice([2, 3, 8])
        doc = [rng.randrange(words) for _ in range(rng.randrange(40))]
        item = [rng.randrange(words) for _ in range(rng.randrange(25))]
        if rng.random() < 0.5 and len(item) > 6:
            doc[3:3] = item[5:] + item[:5]
        least = rng.choice([2, 3, 5])
        a, b = np.array(doc, np.uint64), np.array(item, np.uint64)
        assert G.tiles(a, b, least) == brute(doc, item, least)


PASSAGE = " ".join(f"w{i}" for i in range(30))


def test_contaminated(spark):
    filler = " ".join(f"x{i}" for i in range(40))
    turned = " ".join([f"W{i}" for i in range(15, 30)] + ["and"] + [f"w{i}" for i in range(15)])
    rows = [(1, f"{filler} {PASSAGE} {filler}"), (2, f"{filler} {turned}"), (3, filler), (4, " ".join(PASSAGE.split()[:12]) + " " + filler), (5, None), (6, ""), (None, PASSAGE), (1, f"{filler} {PASSAGE} {filler}"), (7, "w1 w2 w3")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(10, PASSAGE), (11, PASSAGE), (12, "a b"), (13, None), (None, "q")], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.item_id) for r in G.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, True, 10), (1, True, 10), (2, True, 10), (3, False, None), (4, False, 10), (5, False, None), (6, False, None), (None, True, 10), (7, False, None)], key=str)
    assert not [r for r in G.contaminated(docs, bench.limit(0)).collect() if r.contaminated]
    assert G.contaminated(docs.limit(0), bench).count() == 0
