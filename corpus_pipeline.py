"""From raw documents to token ids: quality rules, near-duplicates, decontamination, surrogates, encoding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return the columns of ``documents``, whatever
they are; the operators get neutral column names, so no extra column can clash with a result.  ``run`` writes each
stage as Parquet in the shared folder and reads it again, so a lost executor costs a part of one stage.

Defined results: an empty table goes through all stages; null texts have no words and are rejected by the quality
rules; of repeated rows one stays; a row without an id can't be named as a representative, so it stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import bpe_replay, compression_rules, hamming_dedup, pii_surrogates, tiling
from lodestrand.llm.common import stored, table
from lodestrand.llm.queries import PII_KEY


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The same rows with columns c0, c1, ..., and what the id and the text are called then."""
    names = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the compression bands let pass."""
    plain, _, text = _plain(docs)
    return _named(compression_rules.judge(plain, text).where("kept"), docs)


#: Near-duplicates in the pipeline: sets of shingles with a similarity of so many hundredths.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and once if its row is repeated."""
    plain, doc_id, text = _plain(docs)
    chosen = hamming_dedup.near_duplicates(plain, doc_id, text, NEAR_PERCENT).where(F.col("kept") & F.col(doc_id).isNotNull()).select(doc_id).distinct()
    stays = plain.join(chosen, doc_id, "left_semi")
    others = [F.xxhash64(c) for c in stays.columns if c != doc_id]
    once = stays.withColumn("copy", F.row_number().over(Window.partitionBy(doc_id, *others).orderBy(F.lit(1)))).where("copy = 1")
    return _named(once.drop("copy").unionByName(plain.where(F.col(doc_id).isNull())), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    plain, _, text = _plain(docs)
    return _named(tiling.contaminated(plain, table(spark, sf_dir, "benchmark"), text=text).where("not contaminated"), docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    plain, _, text = _plain(docs)
    return _named(pii_surrogates.replace(plain, PII_KEY, text), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): packed token ids of each text, and a digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_replay.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = bpe_replay.decode(encoded, path)
    return decoded.select("doc_id", bpe_replay.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("encoding", encoding),
]

#: SQL has no zstandard, and BPE merges can't be replayed in it; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
