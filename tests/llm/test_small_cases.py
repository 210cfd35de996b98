"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestrand.llm import attention_lm, bpe_replay, compression_rules, hamming_dedup, pii_surrogates, quality_classifier, suffix_dedup, tiling, url_templates
from lodestrand.llm.blocks import blocks
from lodestrand.llm.components import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly boil strange soup for them all and nobody minds"
TEXTS = [None, "", " \n\t ", "one", "Two words", PROSE, PROSE, PROSE.upper(), PROSE + " again", "a b c d e " * 12, LONG, "é\u00a0日本 \x1c x", "line one\nline one\n\n \nline two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1.5) for i, t in enumerate(TEXTS)] + [(5, PROSE, "en", 1.5), (None, "lonely text with seven words in it", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double").repartition(3).cache()


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_compression_bands(docs):
    got = {r.doc_id: r for r in compression_rules.judge(docs).collect()}
    assert len(got) == len(TEXTS) + 1 and isinstance(got[5].kept, bool) and compression_rules.judge(docs.limit(0)).count() == 0
    for i, text in enumerate(TEXTS):
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(grams)
        repeat = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (len(words) < 10 or 100 * len(repeat) > 20 * len(words))
    assert got[5].kept and not got[0].kept and not got[9].kept


def test_bands_reject_repetition_and_noise():
    import pyarrow as pa

    noise = hashlib.sha512(b"x").hexdigest()
    random = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:12] for i in range(400))
    block = next(blocks(pa.array(["ab " * 3000, PROSE * 30, noise, PROSE])))
    found = compression_rules.measure(block)
    assert found["whole_ratio"][0] > 8 and not found["kept"][0] and not found["kept"][1] and found["kept"][3]
    assert compression_rules.measure(next(blocks(pa.array([random]))))["whole_ratio"][0] < 2


def test_bands_reject_wrapped_base64_of_any_length():
    import base64

    def wrapped(n, width):
        data = base64.b64encode(np.random.default_rng(n).bytes(n)).decode()
        return "\n".join(data[i : i + width] for i in range(0, len(data), width))[:n]

    noise = [wrapped(n, width) for n in (215, 256, 300, 400, 512, 900, 1024, 1025, 4096, 4097, 20_000, 65_000, 200_000) for width in (12, 20)] + [wrapped(n, 76) for n in (900, 2000, 4096, 20_000, 65_000, 200_000)]
    found = compression_rules.measure(next(blocks(pa.array(noise))))
    assert not found["base_failed"].any() and not found["kept"].any()


def test_ratios_and_verdicts_against_plain_zstandard(spark):
    import base64

    import zstandard

    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    prose = " ".join(d for d in docs if len(d) > 500)[:9000]
    noise = base64.b64encode(np.random.default_rng(5).bytes(4000)).decode()
    noise = "\n".join(noise[i : i + 20] for i in range(0, len(noise), 20))
    docs += ["", "x", prose[:2047], prose[:2048], prose[:2049], prose[:2100] + noise[:1900], prose[:6144] + noise[:2000], noise[:1500] + prose[:1500]]
    got = compression_rules.measure(next(blocks(pa.array(docs), 1 << 40)))
    size = lambda x: len(zstandard.compress(x, 3))
    for i, text in enumerate(x.encode() for x in docs):
        whole = len(text) / size(text) if text else 1.0
        pieces = [text[k : k + 2048] for k in range(0, len(text), 2048)] if len(text) >= 2048 else []
        if pieces and len(pieces[-1]) < 2048:
            pieces[-1] = text[-2048:]
        out = sum(not 1.5 <= 2048 / size(p) <= 4.2 for p in pieces) / len(pieces) if pieces else 0.0
        low, high = next((a, b) for n, a, b in compression_rules.WHOLE_BANDS if len(text) <= n)
        assert abs(got["whole_ratio"][i] - whole) < 1e-9 and abs(got["chunk_share"][i] - out) < 1e-9
        assert got["kept"][i] == (low <= whole <= high and out <= 0.25 and not got["base_failed"][i])
    assert not got["kept"][-3:].any()  # noise at the end or the start of prose


def test_lines_belong_to_their_own_document():
    texts = ["", "a\n", "b\nb\n", "\n", "b\na\na", "\n\nc\n", "c"]
    assert compression_rules.measure(next(blocks(pa.array(texts))))["n_dup_lines"].tolist() == [0, 0, 1, 0, 1, 0, 0]


def similar(a, b):
    return 100 * len(a & b) >= 85 * len(a | b) if a and b else False


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_of(sets):
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if similar(sets[a], sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates(docs):
    got = [r for r in hamming_dedup.near_duplicates(docs).collect() if r.doc_id is not None]
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = components_of(sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(sets[i]), want[i], want[i] == i) for i in [*sets, 5])
    assert hamming_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base) if i % 3 else [f"u{i}{k}" for k in range(40)] + base[:60]
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 9)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components_of({i: shingles(t) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in hamming_dedup.near_duplicates(df).collect()} == want
    monkeypatch.setattr(hamming_dedup, "BLOCK_SETS", 4)
    assert {r.doc_id: r.component_id for r in hamming_dedup.near_duplicates(df).collect()} == want


def test_pigeonhole_index_meets_all_pairs():
    rng = np.random.default_rng(1)
    lanes = hamming_dedup.chunk_lanes()
    for _ in range(500):
        off = set(rng.choice(hamming_dedup.LANES, hamming_dedup.MOST_DIFFERENT, replace=False).tolist())
        assert any(not off & set(chosen) for chosen in lanes)


def test_index_meets_all_pairs_at_other_similarities():
    rng = np.random.default_rng(1)
    assert [hamming_dedup.most_different(p) for p in (85, 80)] == [15, 18]
    for percent in (70, 80, 90):
        most = hamming_dedup.most_different(percent)
        lanes = hamming_dedup.chunk_lanes(most)
        for _ in range(300):
            off = set(rng.choice(hamming_dedup.LANES, most, replace=False).tolist())
            assert any(not off & set(chosen) for chosen in lanes)


def test_the_pipeline_drops_near_copies_at_0_8(spark):
    import corpus_pipeline

    words = [f"n{i}" for i in range(104)]
    near, far = [*words], [*words]
    for k in (20, 60):  # ten of 100 shingles: 90 / 110 = 0.82
        near[k] = f"m{k}"
    for k in (20, 50, 80):  # 85 / 115 = 0.74
        far[k] = f"f{k}"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]


def test_components_without_local_finish(spark, monkeypatch):
    from lodestrand.llm import components as C

    monkeypatch.setattr(C, "LOCAL_EDGES", 0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5)] + [(300, k) for k in range(301, 330)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    got = {r.node: r.root for r in components(df, "u", "v").collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200, **{k: 300 for k in range(300, 330)}}


def test_repeated_passages(spark):
    passage = [f"p{i}" for i in range(80)]
    rows = [(1, ["a"] * 3 + passage + ["b"] * 9), (2, [f"c{i}" for i in range(90)] + passage), (3, passage[:49] + [f"d{i}" for i in range(60)]), (4, [f"e{i}" for i in range(70)]), (5, [f"e{i}" for i in range(70)]), (6, passage[10:40] * 4)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(7, None), (8, ""), (9, LONG), (None, " ".join(f"f{i}" for i in range(60)))], "doc_id long, text string").withColumn("start", F.lit("x"))
    got = defaultdict(list)
    for r in suffix_dedup.repeated_passages(df).collect():
        got[r.doc_id].append((r.start, r.end))
    assert got == {1: [(3, 83)], 2: [(90, 170)], 4: [(0, 70)], 5: [(0, 70)]}
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0


def test_repeated_passages_against_brute_force(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"x{k}" for k in rng.integers(0, 1 << 40, n)]
    long, short = fresh(74), fresh(51)
    texts = [fresh(9) + long + fresh(30), fresh(40) + long + fresh(12), fresh(20) + short + fresh(3), short + fresh(25)]
    # many documents hold 47 words from the midst of the passages, with something else around them
    texts += [fresh(rng.integers(5, 60)) + core + fresh(rng.integers(5, 60)) for core in (long[18:65], short[2:49]) for _ in range(60)]
    near = fresh(260)
    for _ in range(25):
        words = list(near)
        for k in rng.integers(0, len(words), 4):
            words[k] = fresh(1)[0]
        texts.append(words)
    holders = defaultdict(set)
    for i, words in enumerate(texts):
        for k in range(len(words) - 49):
            holders[tuple(words[k : k + 50])].add(i)
    want = {}
    for i, words in enumerate(texts):
        spans = []
        for k in range(len(words) - 49):
            if len(holders[tuple(words[k : k + 50])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        if spans:
            want[i] = spans
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in suffix_dedup.repeated_passages(df).orderBy("start").collect():
        got[r.doc_id].append([r.start, r.end])
    assert set(want) >= {0, 1, 2, 3} and got == want


def test_surrogates_beyond_the_space_of_a_format(spark, monkeypatch):
    monkeypatch.setattr(pii_surrogates, "SYLLABLES", {k: v[:2] for k, v in pii_surrogates.SYLLABLES.items()})
    monkeypatch.setattr(pii_surrogates, "MOST_DRAWS", 30)
    letters = "abcdefgh"
    said = [f"Mr Z{a}{b}" for a in letters for b in letters] + [f"госпожа Ж{a}{b}" for a in "абвгде" for b in "абвгде"] + [f"+7 {k // 100:02} {k % 100:02}" for k in range(10_000)]
    df = spark.createDataFrame([(i, f"say {x}, then go") for i, x in enumerate(said)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii_surrogates.replace(df, "key").collect()}
    new = [got[i].text.removeprefix("say ").removesuffix(", then go") for i in range(len(said))]
    assert all(r.n_replaced == 1 for r in got.values()) and len(set(new)) == len(said) and not set(new) & set(said)
    assert all(re.fullmatch(r"Mr [A-Z][a-z]+|госпожа [А-Я][а-я]+|[+]7 [0-9]{2} [0-9]{2,}", x) for x in new)


def test_full_names_share_the_family_name(spark, monkeypatch):
    """Whatever clashes and is drawn again, a family keeps one name with and without given names."""
    monkeypatch.setattr(pii_surrogates, "SYLLABLES", {k: v[:3] for k, v in pii_surrogates.SYLLABLES.items()})
    families = [f"Q{a}{b}" for a in "abcdefgh" for b in "xyzwv"]
    said = [f"Mr {f}" for f in families] + [f"Mrs {g} {f}" for f in families for g in ("Ann", "Eve")] + [f"Dr {g} {f}" for f in families for g in ("Ann", "Bob")]
    got = pii_surrogates.replace(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4), "key").collect()
    new = {said[r.doc_id]: r.text for r in got}
    assert len(set(new.values())) == len(said) and not set(new.values()) & set(said)
    for f in families:
        assert len({x.split()[-1] for old, x in new.items() if old.split()[-1] == f}) == 1
    for g in ("Mrs Ann", "Mrs Eve", "Dr Ann", "Dr Bob"):
        assert len({x.split()[1] for old, x in new.items() if old.startswith(g + " ")}) == 1


def test_surrogates_against_plain_python(spark):
    """On whole documents: what is no mention stays, and real and new entities of a type match one to one."""
    import regex

    pattern = regex.compile(pii_surrogates.PATTERN)
    kinds = {k: regex.compile(p) for k, p in pii_surrogates.PATTERNS.items()}
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in pii_surrogates.replace(table, "key").collect()}
    there, back, seen = {}, {}, Counter()
    for i, text in old.items():
        mentions = list(pattern.finditer(text))
        assert got[i].n_replaced == len(mentions)
        new, at, rest = got[i].text or "", 0, 0
        for m, after in zip(mentions, [*mentions[1:], None][: len(mentions)], strict=True):
            before = text[rest : m.start()]
            assert new.startswith(before, at)
            at += len(before)
            gap = text[m.end() : after.start() if after else len(text)]
            end = new.index(gap, at + 1) if after else len(new) - len(gap)
            made, raw = new[at:end], m[0]
            kind = next(k for k, p in kinds.items() if p.fullmatch(text, m.start(), m.end()))
            digits = lambda x: regex.sub("[^0-9]", "", x)
            canon = {"email": str.lower, "phone": digits, "card": digits, "ssn": digits, "iban": lambda x: x.replace(" ", "")}.get(kind, lambda x: x)
            if kind != "name":
                assert there.setdefault((kind, canon(raw)), canon(made)) == canon(made) and back.setdefault((kind, canon(made)), canon(raw)) == canon(raw)
            if kind in ("ssn", "card", "iban"):
                assert regex.sub("[0-9]", "0", raw) == regex.sub("[0-9]", "0", made) or kind == "iban"
            if kind == "ip":
                assert regex.fullmatch(pii_surrogates.PATTERNS["ip"], made)
            seen[kind] += 1
            at, rest = end, m.end()
        assert new[at:] == text[rest:]
    assert not set(there) & set(back) and len(seen) >= 3


def test_quality_classifier(spark, docs):
    rows = [(i, PROSE if i % 2 else "$$$ ### &&& " * 8) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier.classify(labelled, labels).collect()
    assert all(r.predicted == r.doc_id % 2 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert len(quality_classifier.classify(docs, labels).collect()) == len(TEXTS) + 2
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_language_model(docs):
    got = attention_lm.score(docs, VOCABULARY).collect()
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(x for r in rows if not held(r.doc_id) for x in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter((r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(counts[x] > 0 for x in tokens(r.text)), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in tokens(r.text)), 4)) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and np.ptp([r.score for r in got if r.doc_id in (5, 6)]) < 1e-4
    assert attention_lm.score(docs.limit(0), VOCABULARY).count() == 0


def skip_table(seed=3):
    return np.log(np.random.default_rng(seed).dirichlet(np.ones(attention_lm.CLASSES), attention_lm.INPUTS)).astype(np.float32)


def test_windows_score_each_id_once_and_attention_is_causal():
    offs = np.array([0, 1, 33, 90, 91, 400])
    for stride in (attention_lm.STRIDE, attention_lm.SPAN):
        _, real, new, text, _ = attention_lm.cut_windows(offs, stride)
        assert (np.bincount(text, new.sum(1)) == np.diff(offs)).all() and not (new & ~real).any()
    w, skip = attention_lm.fresh(), skip_table()
    rows = np.random.default_rng(0).integers(0, attention_lm.INPUTS, (1, attention_lm.SPAN))
    other = rows.copy()
    other[0, 20:] = 1
    odds = lambda x: np.exp([attention_lm.forward(w, skip, x, np.full(x.shape, c))[0][0] for c in range(attention_lm.CLASSES)])
    a, b = odds(rows), odds(other)
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5) and not np.allclose(a[:, 20:], b[:, 20:], atol=1e-3) and np.allclose(a.sum(0), 1, atol=1e-4)


def test_subwords_of_one_slot_are_all_found():
    tokens = {bytes([b]): b for b in range(256)} | {f" w{i}".encode(): 256 + i for i in range(9000)}
    cutter = attention_lm.Subwords(tokens)
    assert len(cutter.more)  # so many share slots
    ids, offs, *_ = cutter.cut(next(blocks(pa.array([" ".join(f"w{i}" for i in range(9000))]))))
    assert ids.tolist() == [*range(256, 9256), cutter.end] and offs.tolist() == [0, 9001]


def test_the_model_is_of_full_size():
    _, _, new, _, index = attention_lm.cut_windows(np.array([0, 400]), attention_lm.STRIDE)
    assert min(np.flatnonzero(row)[0] for row in new[index > 0]) >= 8
    assert (attention_lm.HEAD, attention_lm.CLASSES) == (44, 64) and attention_lm.LONGEST >= 8


def plain_scores(texts, learnt, vocabulary):
    """log10 probability of each text by an untrained model, one id after another in plain Python."""
    data = open(vocabulary, "rb").read()
    cutter = attention_lm.Subwords.read(data)
    cut = lambda t: cutter.cut(next(blocks(pa.array([t]))))[0].tolist()
    counts, pairs = Counter(), Counter()
    for t in learnt:
        ids = cut(t)
        counts.update(ids)
        pairs.update(zip([None, *ids], ids, strict=False))
    c = attention_lm.Counted.of_ids(np.array([counts[i] for i in range(cutter.size)], float), cutter.first)
    row = lambda i: 0 if i is None else int(c.row[i])
    follows, of_row = Counter(), Counter()
    for (a, b), n in pairs.items():
        follows[row(a), int(c.of[b])] += n
        of_row[row(a), b] += n
    even = np.exp(c.skip[0].astype(float))
    w = {k: x.astype(float) for k, x in attention_lm.fresh().items()}
    out = []
    for t in texts:
        ids, total = cut(t), 0.0
        for at, i in enumerate(ids):
            window = 0 if at < attention_lm.SPAN else 1 + (at - attention_lm.SPAN) // attention_lm.STRIDE
            start = window * attention_lm.STRIDE
            before = [row(None if k == 0 else ids[k - 1]) for k in range(start, at + 1)]
            x = np.array([w["rows"][r] + w["places"][k] for k, r in enumerate(before)])
            looks = np.array([(x[-1] @ w["q"]) @ (x[k] @ w["k"]) / 4 + w["far"][len(x) - 1 - k] for k in range(len(x))])
            odds = np.exp(looks) / np.exp(looks).sum()
            h = x[-1] + sum(o * (x[k] @ w["v"]) for k, o in enumerate(odds)) @ w["o"]
            n_row = sum(n for (r, _), n in follows.items() if r == before[-1])
            skip = np.array([np.log((follows[before[-1], k] + attention_lm.PRIOR * even[k]) / (n_row + attention_lm.PRIOR)) for k in range(attention_lm.CLASSES)])
            logits, k = h @ w["out"] + skip, int(c.of[i])
            p = np.exp(logits[k]) / np.exp(logits).sum()
            kept = {b: n for (r, b), n in of_row.items() if r == before[-1] and int(c.of[b]) == k and n > 0}
            if k >= attention_lm.HEAD:
                n = follows[before[-1], k]
                left = 1 - sum((m - attention_lm.DISCOUNT) / n for m in kept.values()) if n else 1
                p *= ((kept[i] - attention_lm.DISCOUNT) / n if i in kept else 0) + left * c.share[i]
            total += log10(p)
        out.append(total)
    return out


def test_scores_equal_plain_ones(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = ["the", "quick", "brown", "fox", "jumps", "Überraschung", "xylophone", "ab", "c", "internationalisation"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(24)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    monkeypatch.setattr(attention_lm, "ROUNDS", 0)  # counts alone, no steps
    got = {r.doc_id: r.score for r in attention_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), VOCABULARY).collect()}
    want = plain_scores(texts, [t for i, t in enumerate(texts) if not held(i)], VOCABULARY)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=0.02)


def test_pairs_that_are_not_sent_count_as_those_sent(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["the", "quick", "brown", "fox", "jumps", "Überraschung", "xylophone", "ab", "c", "internationalisation", *(f"w{i}" for i in range(300))]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(30)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(attention_lm, "ROUNDS", 0)
    scores = []
    for most in (attention_lm.MOST_PAIRS, 20, 0):
        monkeypatch.setattr(attention_lm, "MOST_PAIRS", most)
        scores.append([r.score for r in attention_lm.score(docs, VOCABULARY).orderBy("doc_id").collect()])
    assert np.allclose(scores[0], scores[1], atol=1e-4) and np.allclose(scores[0], scores[2], atol=1e-4)


def test_spots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3000):
        keys = np.unique(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
        spots = attention_lm.Spots(keys)
        assert spots.of(keys).tolist() == list(range(len(keys))) and (spots.of(np.setdiff1d(rng.integers(0, 1 << 40, 500), keys)) < 0).all()


def test_each_id_is_learnt_once(monkeypatch):
    words = [f"w{i}" for i in range(700)]
    cutter = attention_lm.Subwords.read(open(VOCABULARY, "rb").read())
    ids, offs, *_ = cutter.cut(next(blocks(pa.array([" ".join(words)]))))
    built = attention_lm.Counted.of_ids(np.bincount(ids, minlength=cutter.size).astype(float), cutter.first)
    learnt, before = Counter(), Counter()

    def step(self, rows, classes, valid):
        learnt.update(classes[valid].tolist())
        before.update(rows[valid].tolist())

    monkeypatch.setattr(attention_lm.Trainer, "step", step)
    for turn in range(attention_lm.ROUNDS):
        list(attention_lm._learn([pa.RecordBatch.from_arrays([pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["ids"])], built, attention_lm.pack(attention_lm.fresh()), turn))
    assert learnt == Counter(built.of[ids].tolist()) and before == Counter([0, *built.row[ids[:-1]].tolist()])


def test_words_met_before_are_neither_sorted_nor_cut_again(monkeypatch):
    cutter = attention_lm.Subwords.read(open(VOCABULARY, "rb").read())
    one = next(blocks(pa.array([" ".join(f"W{i} der{i} über" for i in range(4000)), None, " fox  x"])))
    first = cutter.cut(one)
    sorted_, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: sorted_.append(len(x)) or unique(x, **more))
    again = cutter.cut(one)
    assert sum(sorted_) == 0 and all((x == y).all() for x, y in zip(first[:2], again[:2], strict=True))
    assert (first[2][first[3]] == again[2][again[3]]).all() and (first[2][first[3]] == one.hashes()).all()


def test_words_whose_slots_others_have_are_cut_as_alone(monkeypatch):
    data, texts = open(VOCABULARY, "rb").read(), [" ".join(f"w{i} x{i * i} foxes" for i in range(j, j + 300)) for j in range(0, 900, 150)]
    alone = [attention_lm.Subwords.read(data).cut(next(blocks(pa.array([t]))))[0] for t in texts]
    monkeypatch.setattr(attention_lm, "_KNOWN_BITS", 6)
    for most in (attention_lm.MEMORY, 500):  # words are forgotten in between
        monkeypatch.setattr(attention_lm, "MEMORY", most)
        cutter = attention_lm.Subwords.read(data)
        for t, want in zip(texts, alone, strict=True):
            ids, _, words, back, *_ = cutter.cut(block := next(blocks(pa.array([t]))))
            assert ids.tolist() == want.tolist() and (words[back] == block.hashes()).all()
        assert len(cutter.over)


def test_words_are_told_apart_by_their_marked_ids():
    texts = ["The the THE x über 東京 東 京 internationalisation", None, "", "a b ab a-b über Über zq~ the", " x "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([False] * 5), pa.array(texts)], names=["id", "held_out", "text"])
    made = list(attention_lm._cut([batch], open(VOCABULARY, "rb").read()))
    assert "text" not in made[0].schema.names  # texts aren't stored again
    block = next(blocks(made[0].column("ids")))
    ids, words, many = attention_lm.words_of(np.frombuffer(block.data.tobytes(), "<u4"), block.offs // 4)
    cutter = attention_lm.Subwords.read(open(VOCABULARY, "rb").read())
    assert ids.tolist() == cutter.cut(next(blocks(batch.column(2))))[0].tolist()
    plain = [lower(x) for t in texts for x in WORD.findall(t or "")]
    assert many.tolist() == [len(WORD.findall(t or "")) for t in texts] and len(words) == len(plain)
    assert len(set(words.tolist())) == len(set(plain)) == len(set(zip(words.tolist(), plain, strict=True)))


def test_a_step_is_one_of_plain_adam():
    rng = np.random.default_rng(9)
    trainer, skip = attention_lm.Trainer(attention_lm.pack(attention_lm.fresh()), skip_table()), skip_table().astype(np.float64)
    w = {k: x.astype(np.float64) for k, x in attention_lm.fresh().items()}
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for t in range(1, 4):
        rows, classes = (rng.integers(0, most, (5, attention_lm.SPAN)) for most in (300, attention_lm.CLASSES))
        valid = rng.random(rows.shape) < 0.8
        trainer.step(rows, classes, valid)
        g = attention_lm.backward(w, rows, attention_lm.forward(w, skip, rows, classes)[1], classes, valid)
        for k, d in g.items():
            at, d = d if k == "rows" else (slice(None), d)
            m[k][at] += 0.1 * (d - m[k][at])
            s[k][at] += 0.01 * (d * d - s[k][at])
            w[k][at] -= attention_lm.RATE * t / 20 * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(s[k][at] / (1 - 0.99**t)) + 1e-6)
    assert all(np.allclose(trainer.w[k], w[k], atol=2e-5) for k in w) and trainer.windows == 15


def test_odds_in_scoring_are_those_of_training():
    rng = np.random.default_rng(6)
    w, skip = {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for k, x in attention_lm.fresh().items()}, skip_table()
    odds = attention_lm.Odds(w, skip)
    for n, since in ((5, 0), (70, 8), (3, 8)):  # arrays are filled again
        rows, classes = rng.integers(0, attention_lm.INPUTS, (n, attention_lm.SPAN)), rng.integers(0, attention_lm.CLASSES, (n, attention_lm.SPAN))
        assert np.allclose(odds.of(rows, classes, since), attention_lm.forward(w, skip, rows, classes, since)[0], atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(2)
    w, skip = {k: x.astype(np.float64) for k, x in attention_lm.fresh().items()}, skip_table().astype(np.float64)
    rows, classes = rng.integers(0, attention_lm.INPUTS, (2, attention_lm.SPAN)), rng.integers(0, attention_lm.CLASSES, (2, attention_lm.SPAN))
    valid = rng.random((2, attention_lm.SPAN)) < 0.8
    loss = lambda: -attention_lm.forward(w, skip, rows, classes)[0][valid].mean()
    g = attention_lm.backward(w, rows, attention_lm.forward(w, skip, rows, classes)[1], classes, valid)
    whole = np.zeros(attention_lm.SHAPES["rows"])
    whole[g["rows"][0]] = g["rows"][1]
    g["rows"] = whole
    for name in attention_lm.SHAPES:
        for at in [np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape), tuple(n // 2 for n in g[name].shape)]:
            kept = w[name][at]
            w[name][at] = kept + 1e-5
            up = loss()
            w[name][at] = kept - 1e-5
            down = loss()
            w[name][at] = kept
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name][at]))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the test tables")
def test_the_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = attention_lm.score(docs, VOCABULARY).where("held_out")
    known = F.col("n_known") == F.col("n_tokens")
    r = held.agg(*[(F.sum(c) / F.sum("n_tokens")).alias(c) for c in ("score", "base_score")], *[F.sum(F.when(known, F.col(c))).alias(f"known_{c}") for c in ("score", "base_score")]).first()
    assert r.score > r.base_score + 0.05 and r.known_score > r.known_base_score


def test_bpe_round_trip(docs):
    ranks = bpe_replay.Vocabulary.read(open(VOCABULARY, "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe_replay.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    got = bpe_replay.decode(encoded, VOCABULARY).withColumn("n", bpe_replay.n_tokens(F.col("ids"))).withColumn("list", bpe_replay.unpack(F.col("ids"))).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = library.encode_ordinary(r.text or "")
        assert r.list == want and r.n == len(want) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe_replay.decode(bpe_replay.encode(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).count() == 0


def test_replay_equals_the_library_on_odd_texts():
    import random

    rng = random.Random(3)
    voc = bpe_replay.Vocabulary.read(open(VOCABULARY, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})
    alphabet = ["a", "aa", "b", "é", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u180e", "\u200b", "\xa0", "0", "12", "٣", "'s", "'S", "'ll", "日本", "🙂", "\x00", "ſ", "_", "the", "ing", "<|endoftext|>", "\r", "\u323c", "\U000323c0", "\U00010948"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * n for n in range(150)] + [" " * 999, "aab" * 70]
    for size, most in ((1 << 22, bpe_replay.CACHE_PIECES), (1 << 10, 300)):  # the second forgets pieces again and again
        coder, bpe_replay.CACHE_PIECES, kept = bpe_replay.Encoder(voc), most, bpe_replay.CACHE_PIECES
        try:
            for block in blocks(pa.array(texts, pa.string()), size):
                ids, offs = coder(block)
                for i in range(len(block)):
                    assert ids[offs[i] : offs[i + 1]].tolist() == library.encode_ordinary(block.text(i).decode())
        finally:
            bpe_replay.CACHE_PIECES = kept


def test_merges_of_lower_rank_go_first():
    """A made-up vocabulary in which merges make pairs of lower rank; against the plain rule, one merge at a time."""
    import random

    rng = random.Random(11)
    for _ in range(40):
        tokens = [bytes([b]) for b in range(256)] + list({"".join(rng.choices("ab", k=rng.randint(2, 5))).encode() for _ in range(14)})
        voc = bpe_replay.Vocabulary({t: i for i, t in enumerate(tokens)})
        pieces = ["".join(rng.choices("ab", k=rng.randint(1, 30))).encode() for _ in range(300)]
        offs = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        ids, many = bpe_replay.replay(np.frombuffer(b"".join(pieces), np.uint8), offs, voc)
        for piece, own in zip(pieces, np.split(ids, np.cumsum(many)[:-1]), strict=True):
            want = [piece[i : i + 1] for i in range(len(piece))]
            while found := [(voc.ranks[a + b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a + b in voc.ranks]:
                i = min(found)[1]
                want[i : i + 2] = [want[i] + want[i + 1]]
            assert [tokens[i] for i in own.tolist()] == want


def test_surrogates(spark):
    rows = [
        (1, "Mail Anna.B@mail.example.com or anna.b@MAIL.example.com, call +1 (743) 555-3824 or +1-743-555-3824."),
        (2, "Cards 4111 1111 1111 1111 and 4111-1111-1111-1111, hosts 70.23.22.57 and 1.2.3.4, again 70.23.22.57"),
        (3, "Mrs. Anna Smith met Mr Smith; господин Петров; 123-45-6789; DE89 3704 0044 0532 0130 00."),
        (4, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"'),
        (5, None), (6, ""), (7, "in 1999-2001 v1.2.3 sold 100 200 300 of 12 34"), (7, "in 1999-2001 v1.2.3 sold 100 200 300 of 12 34"), (None, "write to anna.b@mail.example.com"),
    ]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_replaced string")
    got = {r.doc_id: r for r in pii_surrogates.replace(df, "key").collect()}
    mails = re.findall(r"\S+@[\w.]+\w", got[1].text)
    assert len(set(mails)) == 1 and mails[0] in got[None].text and "anna" not in got[1].text.lower()
    phones = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", got[1].text)
    assert len(phones) == 2 and len(set(phones)) == 1 and "555-3824" not in got[1].text
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2].text)]
    digits = [int(c) for c in cards[0]]
    assert len(set(cards)) == 1 and cards[0] != "4" + "1" * 15 and sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    hosts = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2].text)
    assert hosts[0] == hosts[2] != hosts[1] and "70.23.22.57" not in hosts
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+); господин (\w+)", got[3].text)
    assert names[2] == names[3] and "Smith" not in got[3].text and re.fullmatch("[А-Яа-я]+", names[4]) and "Петров" not in got[3].text
    iban = re.search(r"DE\d\d(?: \w{4}){4} \w\w", got[3].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[4].text) and "f33e" not in got[4].text
    assert got[5].text is None and got[6].text == "" and got[7].text == rows[6][1] and got[7].n_replaced == 0
    assert pii_surrogates.replace(df.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With almost no room every draw clashes with others or with real entities."""
    monkeypatch.setattr(pii_surrogates, "surrogate", lambda kind, canon, draw, n: F.pmod(F.xxhash64(canon, draw), F.lit(400)).cast("string"))
    df = spark.createDataFrame([("n", str(i)) for i in range(60)], "kind string, canon string")
    made = pii_surrogates._drawn(df, "key").collect()
    assert len({r.made for r in made}) == 60 and not {r.made for r in made} & {str(i) for i in range(60)}


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow")]


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7/x?q", "https://b.com/en/1", "x://com/en/", "http://notcom/en/1", None, "no scheme", "http://h.com", "http://h.com?x://y/en/", "http://example.com/en/8#z", ""]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(1, urls[1], "v"), (None, urls[1], "v")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(df, RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") and got[1] == ("b.com", "/en/1", "com/en/", "block") and got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == ("notcom", "/en/1", None, "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("h.com", "", None, "allow")
    assert got[7] == ("h.com", "", None, "allow") and got[8] == ("example.com", "/en/8", "com/en/", "block") and url_templates.judge(df, RULES).count() == 12
    assert url_templates.judge(df.limit(0), RULES).count() == 0


def test_url_templates_reject_bad_branches(spark):
    bad = [(f"http://s.org/buy/{i}.html",) for i in range(60)]
    good = [(f"http://s.org/news/{i}",) for i in range(60)]
    df = spark.createDataFrame(bad + good, "url string").withColumn("page_id", F.monotonically_increasing_id())
    rules = [("s.org", "/buy/1", "block"), ("s.org", "/buy/2", "block"), ("s.org", "/news/1", "allow"), ("s.org", "/news/2", "allow")]
    got = url_templates.judge(df, rules).collect()
    assert {r.verdict for r in got if r.path.startswith("/buy/")} == {"block"} and {r.verdict for r in got if r.path.startswith("/news/")} == {"allow"}
    assert {r.template for r in got} == {"/buy/*.html", "/news/*"}


def test_url_templates_judge_unlabelled_branches_as_their_node(spark):
    rows = [f"http://s.com/en/a{i}" for i in range(20)] + [f"http://s.com/de/b{i}" for i in range(20)] + [f"http://t.com/de/c{i}" for i in range(20)]
    got = url_templates.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), [("com", "/en/", "block"), ("t.com", "/x", "allow")]).collect()
    assert {r.verdict for r in got if r.host == "s.com"} == {"block"} and {r.verdict for r in got if r.host == "t.com"} == {"allow"}


def test_url_trees_grow_to_the_end_of_paths(spark):
    deep = "/".join("abcdefghij")
    rows = [f"http://s.org/{deep}/bad/{i}" for i in range(30)] + [f"http://s.org/{deep}/good/{i}" for i in range(30)] + ["http://u.org/" + "x/" * 3000, None, "", "no host", "ftp://U.org"]
    rules = [("s.org", f"/{deep}/{kind}/{k}", "block" if kind == "bad" else "allow") for kind in ("bad", "good") for k in "12"]
    got = url_templates.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.host == "s.org":
            assert r.template == f"/{deep}/{'bad' if '/bad/' in r.path else 'good'}/*" and r.verdict == ("block" if "/bad/" in r.path else "allow")
    assert {r.template for r in got if r.host == "u.org"} == {"/**"}


def test_ids_may_be_strings(spark):
    copy = " ".join(f"w{i}" for i in range(80))
    rows = [("b", copy), ("a", copy + " more"), ("c", "other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    near = {r.doc_id: r for r in hamming_dedup.near_duplicates(docs).collect()}
    assert near["b"].component_id == near["a"].component_id == "a" and near["a"].kept and not near["b"].kept and near["c"].kept
    assert sorted((r.doc_id, r.start, r.end) for r in suffix_dedup.repeated_passages(docs).collect()) == [("a", 0, 80), ("b", 0, 80)]
    bench = spark.createDataFrame([("q2", copy), ("q1", copy)], "item_id string, text string")
    got = {r.doc_id: r for r in tiling.contaminated(docs, bench).collect()}
    assert got["a"].item_id == got["b"].item_id == "q1" and got["a"].contaminated and not got["c"].contaminated and got["c"].item_id is None


def test_short_benchmark_items(spark):
    docs = spark.createDataFrame([(1, "he said that Four Words Item Here was it"), (2, "four words item"), (3, "xx yy zz and more " * 5000), (4, "yes no")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "four words item here"), (2, "xx yy zz"), (3, "yes"), (4, "yes no"), (5, "")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in tiling.contaminated(docs, bench).collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (True, 2), 4: (False, None)}
    assert {r.doc_id for r in tiling.contaminated(docs, bench, shortest=1).where("contaminated").collect()} == {1, 3, 4}
