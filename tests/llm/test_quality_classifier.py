"""Features of words and characters, scores, and training against plain loops."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import math

import numpy as np
import pyarrow as pa

from lodestrand.llm import quality_classifier as Q
from lodestrand.llm.blocks import blocks

TEXTS = ["the cat cat sat", "", "привет мир привет", "日本 語", "naïve café — naïve", "a", " x\ty ", "été\nété", "the cat cat sat", "ab" * 40, "𝒳y z😀😀"]
SPACES = " \t\n\x0b\x0c\r"


def grams(text):
    """All pieces of 3 to 5 characters whose inner ones are no white space; white space counts as a blank."""
    text = "".join(" " if c in SPACES else c for c in text)
    return [text[i : i + n] for n in Q.GRAMS for i in range(len(text) - n + 1) if " " not in text[i + 1 : i + n - 1]]


def words(text):
    return "".join(" " if c in SPACES else c for c in text).split(" ") if text.strip(SPACES) else []


def test_features_are_words_and_character_grams():
    named, taken = {}, {}
    for text in TEXTS:
        parts = [b.tolist() for b, _ in Q._features(next(blocks(pa.array([text]))))] if text else [[], []]
        own = [w for w in words(text) if w]
        assert len(parts[0]) == len(own) and parts[1] == [Q.AGAIN] * sum(a == b for a, b in zip(own, own[1:]))
        found = [x for p in parts[2:] for x in p]
        for kind, names, buckets in (("w", own, parts[0]), ("g", grams(text), found)):
            assert len(names) == len(buckets)
            for name, bucket in zip(names, buckets):
                assert named.setdefault((kind, name), bucket) == bucket  # a feature always has its bucket
                taken.setdefault(bucket, set()).add((kind, name))
    assert sum(len(x) > 1 for x in taken.values()) <= 2  # and hardly one that another has


def test_scores_of_a_block_are_those_of_single_texts():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1 << Q.BUCKET_BITS).astype(np.float32)
    block = next(blocks(pa.array(TEXTS)))
    got = Q.score_block(block, weights, 0.25)
    for i, text in enumerate(TEXTS):
        buckets = [x for b, _ in Q._features(next(blocks(pa.array([text])))) for x in b.tolist()] if text else []
        mean = sum(float(weights[b]) for b in buckets) / max(1, len(buckets))
        assert abs(got[i] - 1 / (1 + math.exp(-(mean + 0.25)))) < 1e-5
    assert got[0] == got[8]


def test_training_by_a_plain_loop():
    block = next(blocks(pa.array(["good fine words", "bad noise", "fine good", "noise noise bad", "words of note"])))
    examples = [(b, s, y) for (b, s), y in zip(Q.bags(block), (1, 0, 1, 0, 1))]
    weights, bias = Q.train(examples)
    rng = np.random.default_rng(Q.SEED)
    vectors = rng.uniform(-1 / Q.DIMENSIONS, 1 / Q.DIMENSIONS, (1 << Q.BUCKET_BITS, Q.DIMENSIONS)).astype(np.float32)
    layer, off = rng.normal(0, 1 / Q.DIMENSIONS, (Q.DIMENSIONS, 2)).astype(np.float32).tolist(), [0.0, 0.0]
    used = sorted({int(x) for b, _, _ in examples for x in b})
    vec = {x: vectors[x].tolist() for x in used}
    step, steps = 0, Q.EPOCHS * len(examples)
    for _ in range(Q.EPOCHS):
        for i in rng.permutation(len(examples)):
            buckets, shares, label = examples[i]
            rate = Q.RATE * (1 - step / steps)
            step += 1
            mean = [sum(float(s) * vec[int(b)][d] for b, s in zip(buckets, shares)) for d in range(Q.DIMENSIONS)]
            logits = [sum(mean[d] * layer[d][k] for d in range(Q.DIMENSIONS)) + off[k] for k in (0, 1)]
            odds = [math.exp(x - max(logits)) for x in logits]
            odds = [x / sum(odds) - (k == label) for k, x in enumerate(odds)]
            back = [sum(layer[d][k] * odds[k] for k in (0, 1)) for d in range(Q.DIMENSIONS)]
            for k in (0, 1):
                off[k] -= 0.1 * rate * odds[k]
                for d in range(Q.DIMENSIONS):
                    layer[d][k] -= rate * mean[d] * odds[k]
            whole = sum(float(s) ** 2 for s in shares)
            for b, s in zip(buckets, shares):
                vec[int(b)] = [v - rate * float(s) / whole * back[d] for d, v in enumerate(vec[int(b)])]
    for x in used:
        assert abs(float(weights[x]) - sum(vec[x][d] * (layer[d][1] - layer[d][0]) for d in range(Q.DIMENSIONS))) < 1e-3
    assert abs(bias - (off[1] - off[0])) < 1e-3
