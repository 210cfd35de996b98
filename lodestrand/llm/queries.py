"""The queries ``opN_<name>`` over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import attention_lm, bpe_replay, compression_rules, hamming_dedup, length_packing, pii_surrogates, quality_classifier, ring_sharding, spelling_sql, spelling_variants, suffix_dedup, tiling, token_alignment, url_sql, url_templates
from lodestrand.llm.common import table

def op1_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: (host, path, verdict) of the query's rules.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


#: Surrogates are drawn with this key here; in earnest it comes from a secret store.
PII_KEY = "an example key"


def op4_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on l.x = r.y),
component as (select x as doc_id, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, component_id = d.doc_id as kept
from documents d join component c on c.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_rules.judge(docs, keep=["doc_id"])


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attention_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", ring_sharding.size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = ring_sharding.assign(rows, "doc_id", 40, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_replay.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = bpe_replay.decode(encoded, path)
    return decoded.select("doc_id", bpe_replay.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_replaced")


def op11_spelling_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return token_alignment.alignment(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_quality": op1_subword_quality,
    "op2_url_templates": op2_url_templates,
    "op3_string_tiling": op3_string_tiling,
    "op4_hamming_dedup": op4_hamming_dedup,
    "op5_compression_bands": op5_compression_bands,
    "op6_attention_lm": op6_attention_lm,
    "op7_sparse_suffixes": op7_sparse_suffixes,
    "op8_bounded_ring": op8_bounded_ring,
    "op9_bpe_replay": op9_bpe_replay,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_spelling_gram": op11_spelling_gram,
    "op12_length_packing": op12_length_packing,
    "op13_pair_bitmaps": op13_pair_bitmaps,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_templates": url_sql.sql(URL_RULES),
    "op4_hamming_dedup": OP4_SQL,
    "op11_spelling_gram": spelling_sql.SQL,
}
