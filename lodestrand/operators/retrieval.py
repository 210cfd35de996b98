"""TF-IDF indexing and hybrid retrieval as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import bucket_crc32, tokens
from lodestrand.operators.shared import written


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each token stands in each text."""
    return texts.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def idf(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf) with smoothed inverse document frequency; total: one row with ``n_docs``."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def vectors(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w): sub-linear term frequency times idf, of unit length."""
    raw = counts.join(weights, "term").select(key, "term", ((1 + F.log(F.col("n").cast("double"))) * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def query_vectors(counts: DataFrame, weights: DataFrame, total: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, term, w): as ``vectors``; a term that no text holds has the weight of document frequency 0, and so lengthens the vector."""
    none = F.log(F.col("n_docs") + 1.0) + 1.0
    raw = counts.join(weights, "term", "left").crossJoin(F.broadcast(total)).select(key, "term", ((1 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", none)).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def top_k(scores: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items of each query, ties by item."""
    ranked = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Inner products of unit vectors through an inverted-index join: (query_id, doc_id, score, rank)."""
    dots = queries.withColumnRenamed("w", "qw").join(index, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), digits).alias("score"))
    return top_k(dots, "query_id", "doc_id", "score", k)


def overlap(query_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, kw): distinct shared terms over the root of the number of query terms."""
    size = query_terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("q"))
    shared = query_terms.join(doc_terms, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size, "query_id").select("query_id", "doc_id", (F.col("shared") / (F.sqrt(F.col("q").cast("double")) + 1e-9)).alias("kw"))


def hybrid(dense: DataFrame, lexical: DataFrame, cut: float = 0.02) -> DataFrame:
    """0.55 x vector + 0.45 x min(keyword, 1), strictly above ``cut``; vector 0 outside the dense candidates."""
    both = lexical.join(dense.select("query_id", "doc_id", F.col("score").alias("vec")), ["query_id", "doc_id"], "full_outer")
    vec, kw = F.coalesce("vec", F.lit(0.0)), F.coalesce("kw", F.lit(0.0))
    scored = both.select("query_id", "doc_id", vec.alias("vec"), kw.alias("kw"), F.round(0.55 * vec + 0.45 * F.least(kw, F.lit(1.0)), 6).alias("score"))
    return scored.where(F.col("score") > cut)


def reasons(hits: DataFrame) -> DataFrame:
    """Why a hit was found, by bands of its scores."""
    kw = F.when(F.col("kw") >= 0.25, "strong keyword match").when(F.col("kw") > 0.05, "partial keyword match")
    vec = F.when(F.col("vec") >= 0.35, "high semantic similarity").when(F.col("vec") > 0.15, "moderate semantic similarity")
    return hits.withColumn("reason", F.concat_ws("; ", kw, vec))


def _blocked(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """One row for about ``size`` vectors."""
    many = -(-rows.count() // size) or 1
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias("b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias(name)).drop("b")


def dense_top_k(items: DataFrame, queries: DataFrame, k: int, query_block: int = 512, item_block: int = 4096) -> DataFrame:
    """Exact top-k by inner product of array columns, without a query's own id.

    Queries meet items in blocks: a pair of blocks is one row and one matrix product, which returns the best of each query.
    """
    pairs = _blocked(queries, "query_id", "qv", query_block, "q").crossJoin(_blocked(items, "doc_id", "v", item_block, "i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                (qi, qv), (ii, iv) = (((x := batch.column(c)[n].values).field("id").to_numpy(), np.stack([np.asarray(v, np.float64) for v in x.field("v").to_pylist()])) for c in (0, 1))
                dots = qv @ iv.T
                dots[qi[:, None] == ii[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ii, dots.shape), -np.round(dots, 5)), axis=1)[:, : k + 4]
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                best = dots[rows, order.ravel()]
                live = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows][live]), pa.array(ii[order.ravel()][live]), pa.array(best[live])], names=["query_id", "doc_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, doc_id long, score double").withColumn("score", F.round("score", 5))
    return top_k(found, "query_id", "doc_id", "score", k)


#: Width of hashed vectors.
WIDTH = 4096


def bucket_weights(counts: DataFrame, total: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, bucket, tf), (bucket, idf)): features hashed into ``WIDTH`` buckets; 1 + ln n of features that share one are added up."""
    hashed = counts.withColumn("bucket", bucket_crc32(F.col("term"), WIDTH))
    tf = hashed.groupBy(key, "bucket").agg(F.sum(1 + F.log(F.col("n").cast("double"))).alias("tf"))
    df = tf.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return tf, df.crossJoin(F.broadcast(total)).select("bucket", (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def bucket_vectors(tf: DataFrame, weights: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """(key, norm, buckets, weights): unit vectors as packed sparse arrays; a bucket that no text has weighs as document frequency 0."""
    none = F.log(F.col("n_docs") + 1.0) + 1.0
    raw = tf.join(weights, "bucket", "left").crossJoin(F.broadcast(total)).select(key, "bucket", (F.col("tf") * F.coalesce("idf", none)).alias("raw"))
    packed = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.array_sort(F.collect_list(F.struct("bucket", "raw"))).alias("x"))  # at most WIDTH entries
    return packed.select(key, "norm", F.transform("x", lambda e: e["bucket"]).alias("buckets"), F.transform("x", lambda e: e["raw"] / F.col("norm")).alias("weights"))


def bucket_top_k(items: DataFrame, queries: DataFrame, k: int, digits: int = 6, query_block: int = 256, item_block: int = 1024) -> DataFrame:
    """(query_id, doc_id, score, rank): exact top-k of packed vectors; blocks of them are unpacked and multiplied, one pair of blocks at a time."""

    asked = _blocked(queries.withColumn("v", F.struct("buckets", "weights")), "query_id", "v", query_block, "q")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), item_block):
                some = batch.slice(at, item_block)
                vectors = pa.StructArray.from_arrays([some.column(1), some.column(2)], ["buckets", "weights"])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.StructArray.from_arrays([some.column(0), vectors], ["id", "v"]))], names=["i"])

    # texts stay where they are: a block is what a task has read
    blocks = items.select(F.col("doc_id").cast("long").alias("id"), "buckets", "weights").mapInArrow(packed, "i array<struct<id:bigint,v:struct<buckets:array<int>,weights:array<double>>>>")
    pairs = asked.crossJoin(blocks)

    def dense(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = block.field("id").to_numpy(), block.field("v")
        buckets, weights = vectors.field("buckets"), vectors.field("weights")
        out = np.zeros((len(ids), WIDTH))
        out[np.repeat(np.arange(len(ids)), buckets.value_lengths().to_numpy()), buckets.flatten().to_numpy()] = weights.flatten().to_numpy()
        return ids, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                (qi, q), (ii, i) = (dense(batch.column(c)[n].values) for c in (0, 1))
                dots = np.round(q @ i.T, digits)
                least = np.partition(dots, max(0, dots.shape[1] - k), axis=1)[:, max(0, dots.shape[1] - k)]
                a, b = np.nonzero((dots >= least[:, None]) & (dots > 0))  # ties of the last one as well
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ii[b]), pa.array(dots[a, b])], names=["query_id", "doc_id", "score"])

    return top_k(pairs.mapInArrow(run, "query_id long, doc_id long, score double"), "query_id", "doc_id", "score", k)


#: A first bound of each question's k-th score comes from its terms that at most this share of the texts hold.
RARE = 0.1


def pruned_search(index: DataFrame, queries: DataFrame, n_docs: int, k: int, digits: int = 6) -> DataFrame:
    """The rows of ``search``, without reading the postings of common terms whole: (query_id, doc_id, score, rank).

    A term adds to no score more than its weight in the question times its largest weight in a text.  The texts that rare terms alone bring up, scored whole, give a question k scores that the
    final ones can't be below.  Terms, smallest bounds first, whose bounds add up to less than the k-th of these can't bring a text among the best by
    themselves: only texts that share another term are candidates, and of these only those that can still reach the bound meet the common terms, by
    text and term.  index: (doc_id, term, w), written; queries: (query_id, term, w).
    """
    most = index.groupBy("term").agg(F.max("w").alias("most"), F.count(F.lit(1)).alias("df"))
    asked = written(queries.withColumnRenamed("w", "qw").join(most, "term").select("query_id", "term", "qw", (F.col("qw") * F.col("most")).alias("bound"), "df"))
    rare = asked.where(F.col("df") <= RARE * n_docs)
    first = rare.join(index, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    likely = written(top_k(first, "query_id", "doc_id", "score", 3 * k).select("query_id", "doc_id"))
    whole = likely.join(asked.select("query_id", "term", "qw"), "query_id").join(index, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    kth = top_k(whole, "query_id", "doc_id", "score", k).where(F.col("rank") == k).select("query_id", (F.col("score") - 10.0**-digits).alias("least"))
    below = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = written(asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))).withColumn("common", below < F.col("least")))
    left = split.where("common").groupBy("query_id").agg(F.sum("bound").alias("rest"))
    found = split.where("not common").join(index, "term").groupBy("query_id", "doc_id", "least").agg(F.sum(F.col("qw") * F.col("w")).alias("part"))
    able = written(found.join(left, "query_id", "left").where(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least")).select("query_id", "doc_id", "part"))
    more = able.select("query_id", "doc_id").join(split.where("common").select("query_id", "term", "qw"), "query_id").join(index, ["doc_id", "term"])
    more = more.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("more"))
    score = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), digits)
    return top_k(able.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", score.alias("score")), "query_id", "doc_id", "score", k)
