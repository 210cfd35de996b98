"""The stages on a small table, against plain Python; and the registered query from end to end."""

import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lodestrand.llm import bpe_replay

PROSE = [" ".join(f"{a}{(i * k + i) % 61}" for i in range(60)) for k, a in ((3, "ra"), (7, "lo"), (11, "mi"), (13, "se"))]
ITEM = " ".join(f"q{i}" for i in range(25))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [
        (1, PROSE[0]), (2, PROSE[0] + " tail"), (3, PROSE[0]), (4, PROSE[1] + " " + ITEM), (5, PROSE[2] + " write to bob.k@mail.example.com"), (6, "spam " * 40),
        (7, None), (8, ""), (9, "too short"), (10, PROSE[3]), (10, PROSE[3]), (None, PROSE[3].replace("se1", "zz") + " and more words to differ from all the others here"),
    ]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], "doc_id long, text string, lang string, kept string, contaminated string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [[1, 2, 3, 4, 5, 10, 10, None], [1, 4, 5, 10, None], [1, 5, 10, None], [1, 5, 10, None]]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted(ids, key=str)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "bob" not in texts[5] and re.search(r"@\w+\.example\.\w+", texts[5]) and texts[1] == PROSE[0]


def test_run(spark, folder):
    ranks = bpe_replay.Vocabulary.read(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {1, 5, 10, None}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == library.encode_ordinary(PROSE[0]) and got[1].n_tokens == len(got[1].ids) // 4


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
