"""Texts that a hash modulo a power of two takes for one another stay apart, in all operators that hash spans."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestrand.llm import bpe_replay, compression_rules, suffix_dedup, tiling
from lodestrand.llm.blocks import Block, blocks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("letters", ["ab", "xy", "01"])
def test_thue_morse_words_have_hashes_of_their_own(letters):
    for n in (64, 1024, 4096):
        one, other = thue_morse(n, *letters)
        block = next(blocks(pa.array([one, other, f"lead {one} {other}"])))
        hashes = block.hashes(lower=False)
        assert hashes[0] != hashes[1] and hashes[0] == hashes[3] and hashes[1] == hashes[4]
        assert len(set(block.spans(block.offs[:-1], block.offs[1:]).tolist())) == 3


def test_encoding(spark):
    one, other = thue_morse(1024)
    texts = [f"{one} {other}", other, one, f"{other}\n{one} {one}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_replay.encode(docs, PATH).collect()}
    assert got == {i: OWN.encode_ordinary(t) for i, t in enumerate(texts)}


def test_pieces_of_one_hash_are_encoded_apart(monkeypatch):
    texts = ["some words and numbers 123", "", "some other words, é日本", "x"]
    coder = bpe_replay.Encoder(bpe_replay._vocabulary(open(PATH, "rb").read()))
    monkeypatch.setattr(Block, "spans", lambda self, starts, ends, lower=False: (ends - starts).astype(np.uint64))
    for block in blocks(pa.array(texts)):
        ids, offs = coder(block)
        assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [OWN.encode_ordinary(t) for t in texts]


def test_lines_and_repeats_are_told_apart():
    one, other = thue_morse(1024)
    found = compression_rules.measure(next(blocks(pa.array([f"{one}\n{other}\n{one}"]))))
    assert found["n_dup_lines"].tolist() == [1]


def test_texts_are_told_apart(spark):
    """Two documents of spaced signs, equal but for a Thue-Morse word against its complement."""
    one, other = (" ".join(w) for w in thue_morse(1024))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(0, f"{one} {words}"), (1, f"{other} {words}")], "doc_id long, text string")
    spans = {(r.doc_id, r.start, r.end) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert {i for i, *_ in spans} == {0, 1} and any(end == 1084 for *_, end in spans)
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    both = spark.createDataFrame([(0, f"{one} {words}"), (1, f"{other} v1 v2 v3 w4 w5 w6 w7 w8 w9 w10 v5 v6")], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in tiling.contaminated(both, items).collect()} == {0: True, 1: False}
