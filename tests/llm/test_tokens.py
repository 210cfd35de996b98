"""Packing and alignment of token ids against plain loops over whole texts."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrand.llm import byte_bpe, length_packing, spaced, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
LONG = " ".join(f"w{i % 977}x{i % 31}" + ("\n" if i % 50 == 0 else "") for i in range(30_000))
TEXTS = [None, "", " ", "\n", "one", " two  spaces ", "a  b", "tab\tand wide　sp ace", "it's we'll 12345 x=1;", "日本語 テキスト 😀 é é", "under▁line", "<s> </s> <|endoftext|> <unk>",
         "\x00 nul \x1c sep \x85 nel", "x" * 5000, "repeat me " * 900, LONG, "​zero​ width", "trailing \n\n  ", "a ̈ b", "  lead", "a b c  d", "﻿bom x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(4, "one", "x", 1), (None, "no id here", None, None)]
    extra = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("length"), F.lit(1).alias("pair"))
    return spark.createDataFrame(rows, "doc_id long, text string, length string, pair int").union(extra).repartition(5, "doc_id").cache()


def test_units_join_to_the_text():
    units = spaced.Units(list)
    for text in TEXTS + TEXTS:
        assert "".join(v for values in units.of(text or "") for v in values) == (" " + text if text else "")
    for text in TEXTS:
        if text:
            ids = [i for values in units.of(text) for u in values for i in A.encode("".join(u), add_special_tokens=False).ids]
            assert ids == A.encode(" " + text, add_special_tokens=False).ids


def test_units_of_a_text_beyond_one_slice(monkeypatch):
    monkeypatch.setattr(spaced, "SIGNS", 40)
    units = spaced.Units(list, most=50)
    for text in TEXTS:
        assert "".join(spaced.slices(text or "")) == (text or "")
        assert "".join(v for values in units.of(text or "") for v in values) == (" " + text if text else "")
        ids = [i for part in spaced.slices(text or "") for i in A.encode(part, add_special_tokens=False).ids]
        assert ids == A.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_give_the_same_ids():
    ids = byte_bpe.encoder(A_PATH)
    assert byte_bpe._ranks(A_PATH) and byte_bpe._ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    signs = [chr(i) for i in range(0x250)]
    texts = [t for t in TEXTS if t] + signs + [f"ab{c}cd {c} {c}{c}1{c}x  {c}" for c in signs] + ["".join(signs), "x" * 30_000, "'s 'T we'LL i'd'd"]
    letter = byte_bpe.letters()
    tokens = [bytes(letter[c] for c in t).decode("utf-8", "ignore") for t in A.get_vocab() if all(c in letter for c in t)]
    for text, plain in zip(texts + tokens, A.encode_batch(texts + tokens, add_special_tokens=False)):
        assert ids(text) == plain.ids


def plain_ids(text):
    return A.encode(text or "", add_special_tokens=False).ids + [2]


def test_packing(spark, docs):
    got = length_packing.pack(docs, A_PATH, range_rows=16).collect()
    cut = Counter()
    for d in docs.collect():
        ids = plain_ids(d.text)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            cut[d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cut
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(r.length for r in got) // 1024) + 1
    assert length_packing.pack(docs.limit(0), A_PATH).count() == 0


def test_ranks_need_one_exchange_and_no_sort_of_spark(spark, docs):
    # a sort or window takes a page of memory in each task, however few rows it has
    plan = length_packing.pack(docs, A_PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for size in (10, 64, 1024):
        for n in (0, 1, 7, 400):
            lengths = rng.integers(1, size + 1, n).tolist() if size < 1024 else np.minimum(size, (rng.pareto(1.0, n) * 40 + 1).astype(int)).tolist()
            bins = []  # plain best fit over single pieces
            for x in sorted(lengths, reverse=True):
                fits = [(b, i) for i, b in enumerate(bins) if b >= x]
                if fits:
                    bins[min(fits)[1]] -= x
                else:
                    bins.append(size - x)
            held = defaultdict(list)
            for length, rank, n_pieces, first, each, offset in length_packing.plan(Counter(lengths), size):
                for k in range(n_pieces):
                    held[first + k // each].append((offset + k % each * length, length))
            assert Counter(x for p in held.values() for _, x in p) == Counter(lengths)
            assert len(held) == len(bins) and sorted(size - sum(x for _, x in p) for p in held.values()) == sorted(bins)
            for p in held.values():
                assert [o for o, _ in sorted(p)] == np.cumsum([0] + [x for _, x in sorted(p)])[:-1].tolist()


def test_plan_of_many_pieces_stays_small():
    counts = {k: 10**9 // k for k in range(1, 1025)}
    lines = length_packing.plan(counts)
    assert sum(n for _, _, n, *_ in lines) == sum(counts.values()) and len(lines) < 20_000
    assert max(first + -(-n // each) for _, _, n, first, each, _ in lines) <= sum(k * n for k, n in counts.items()) / 1024 + 2


def plain_alignment(text):
    """(n_a, n_b, groups, links) of a whole text."""
    if not text:
        return 0, 0, [], []
    whole = (" " + text).encode()
    letters = byte_bpe.letters()
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(letters[c] for c in A.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return 0, 0, [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i), ends_b.index(end, j)
        groups.append((ids_a[i : x + 1], ids_b[j : y + 1]))
        links.append((ids_a[x], ids_b[y]))
        i, j = x + 1, y + 1
    return len(ids_a), len(ids_b), groups, links


@pytest.mark.parametrize("dense, block", [(4096, 16 << 20), (3, 20_000)])
def test_alignment(spark, docs, dense, block, monkeypatch):
    rows = docs.collect()
    plain = [plain_alignment(r.text) for r in rows]
    count = Counter(pair for *_, links in plain for pair in links)
    most = defaultdict(int)
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter()
    for r, (n_a, n_b, groups, links) in zip(rows, plain):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        want[r.doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest] += 1
    if dense == 4096:
        got = token_alignment.alignment(docs, A_PATH, B_PATH)
    else:  # small blocks
        built = token_alignment.stored(token_alignment.index(docs, A_PATH, B_PATH, block_bytes=block))
        postings = built.where("pair is not null").select("block", "pair", "planes")
        counts = token_alignment.pair_counts(postings)
        got = token_alignment.scores(built.where("pair is null").drop("pair", "planes"), postings, counts).selectExpr("*", "n_groups as n_links")
        holding = Counter(p for *_, links in plain for p in set(links))
        assert {(r.pair >> 20, r.pair & 0xFFFFF): (r.n_docs, r.n_links) for r in counts.collect()} == {p: (holding[p], n) for p, n in count.items()}
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want
    assert got.count() == len(rows) and token_alignment.alignment(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_bitmaps_of_common_pairs():
    rng = np.random.default_rng(1)
    pairs = np.repeat([5, 7, 9], [200_000, 30_000, 2])
    places = np.concatenate([rng.integers(0, 1 << 16, 200_000), rng.integers(0, 9000, 30_000), [4, 65_535]])
    found, planes = token_alignment.bitmaps(pairs, places)
    assert found.tolist() == [5, 7, 9] and any(len(p) == 8192 for p in planes[0]) and any(len(p) < 8192 for p in planes[0])
    for pair, own in zip(found, planes):
        times = Counter(places[pairs == pair].tolist())
        got = Counter()
        for k, p in enumerate(own):
            got.update({int(i): 1 << k for i in token_alignment.members(p)})
        assert got == times and token_alignment.popcount(own) == (len(times), sum(times.values()))
