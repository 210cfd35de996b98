"""A stored inverted index: postings in buckets of terms, refreshed by segments, refused when stale.

Below its folder an index has ``segments/segment=N/bucket=B`` (term, key, n), and for each version V ``keys/version=V`` (key, digest, segment),
``terms/version=V`` (term, df), ``norms/version=V`` (key, norm) and ``manifest/version=V``, one row that is written last: what
an interrupted refresh left behind belongs to no version.  A posting counts if its key's row names its segment, so a refresh tokenizes
new and changed texts only, writes them as one more segment, and drops nothing.  A search reads the buckets of its terms and no text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import retrieval as R
from lodestrand.operators.hybrid import bags

BUCKETS = 64
#: Weights of so many terms go with tasks when norms are worked out.
SENT = 100_000
MANIFEST = "version long, n_docs long, checksum decimal(38, 0), first_segment int, segments int"
#: Segments after which a refresh writes all postings anew as one.
MOST_SEGMENTS = 20


class StaleIndex(Exception):
    """The index isn't that of the texts it was asked about."""


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("digest"))


def checksum(keys: DataFrame) -> DataFrame:
    """One row (n_docs, checksum) that changes with any key or digest, in whatever order."""
    return keys.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.xxhash64("key", "digest").cast("decimal(38, 0)")), F.lit(0)).cast("decimal(38, 0)").alias("checksum"))


@dataclass
class Index:
    spark: SparkSession
    path: str
    version: int
    n_docs: int
    checksum: int
    first_segment: int
    segments: int

    def read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/version={self.version}")

    @cached_property
    def keys(self) -> DataFrame:
        return self.read("keys", "key string, digest string, segment int")

    @cached_property
    def terms(self) -> DataFrame:
        return self.read("terms", "term string, df long")

    @cached_property
    def norms(self) -> DataFrame:
        return self.read("norms", "key string, norm double")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(term, key, n) of this version, of some buckets only if given."""
        rows = self.spark.read.schema("term string, key string, n long, segment int, bucket int").option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/segments/segment={s}" for s in range(self.first_segment, self.first_segment + self.segments)])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if self.segments == 1:  # of one segment all postings count
            return rows.select("term", "key", "n")
        return rows.join(self.keys.select("key", "segment"), ["key", "segment"], "left_semi").select("term", "key", "n")

    def weights(self) -> DataFrame:
        """(term, idf): the state that new texts are weighted with."""
        return self.terms.select("term", (F.log((F.lit(self.n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))

    def check(self, docs: DataFrame, key: str, text: str) -> None:
        found = checksum(digests(docs, key, text)).first()
        if (found["n_docs"], found["checksum"]) != (self.n_docs, self.checksum):
            raise StaleIndex(f"the index has version {self.version} of {self.n_docs} texts; refresh it")


def load(spark: SparkSession, path: str) -> Index | None:
    """The newest version, or nothing where none was finished."""
    try:
        newest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException:
        return None
    return Index(spark, path, newest["version"], newest["n_docs"], newest["checksum"], newest["first_segment"], newest["segments"]) if newest else None


def refresh(docs: DataFrame, path: str, key: str, text: str) -> Index:
    """The index at ``path`` brought to the state of ``docs``, whose keys are unique; nothing is written if they didn't change."""
    spark, before = docs.sparkSession, load(docs.sparkSession, path)
    now = digests(docs, key, text)
    if before is None:
        changed, kept, first, segment, version = now, None, 0, 0, 0
    else:
        found = checksum(now).first()
        if (found["n_docs"], found["checksum"]) == (before.n_docs, before.checksum):
            return before
        version, first, segment = before.version + 1, before.first_segment, before.first_segment + before.segments
        changed, kept = now.join(before.keys, ["key", "digest"], "left_anti"), now.join(before.keys, ["key", "digest"]).select("key", "digest", "segment")
        if before.segments >= MOST_SEGMENTS:
            changed, kept, first = now, None, segment
    texts = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text")).join(changed.select("key"), "key", "left_semi")
    each = bags(texts, "text").select("key", F.explode(F.arrays_zip("words", "ns")).alias("x"))  # counted where texts are read
    counts = each.select(F.col("x.words").alias("term"), "key", F.col("x.ns").cast("long").alias("n"), bucket_of(F.col("x.words")).alias("bucket"))
    counts.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/segments/segment={segment}")
    new = changed.select("key", "digest", F.lit(segment).alias("segment"))
    at = lambda what: f"{path}/{what}/version={version}"
    (new if kept is None else kept.unionByName(new)).write.mode("overwrite").parquet(at("keys"))
    totals = checksum(spark.read.schema("key string, digest string").parquet(at("keys"))).first()
    made = Index(spark, path, version, totals["n_docs"], totals["checksum"], first, segment + 1 - first)
    valid = made.postings()
    valid.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(at("terms"))
    norms(valid, made.weights()).write.mode("overwrite").parquet(at("norms"))
    spark.createDataFrame([(version, made.n_docs, made.checksum, made.first_segment, made.segments)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return made


def norms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, norm): postings of the ``SENT`` commonest terms stay where they are, others meet their weights by a join; tasks add up what they have of a key."""
    often = weights.orderBy("idf", "term").limit(SENT)
    raw = (1 + F.log(F.col("n").cast("double"))) * F.col("idf")
    met = postings.join(F.broadcast(often), "term", "left").withColumn("sent", F.col("idf").isNotNull())
    rest = met.where("not sent").drop("idf").join(weights, "term")
    parts = met.where("sent").select("key", (raw * raw).alias("part")).unionByName(rest.select("key", (raw * raw).alias("part")))
    return parts.groupBy("key").agg(F.sqrt(F.sum("part")).alias("norm"))


def search(index: Index, questions: DataFrame, k: int = 10, ties: Column | str = "key", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the texts nearest to each question (query_id, text), from the postings of its terms; equal scores go by ``ties``."""
    total = index.spark.range(1).select(F.greatest(F.lit(index.n_docs), F.lit(1)).alias("n_docs"))
    counts = R.term_counts(questions, "query_id", "text")
    wanted = R.query_vectors(counts, index.weights(), total).withColumnRenamed("w", "qw")
    buckets = [r["bucket"] for r in counts.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]  # at most BUCKETS
    held = index.postings(buckets).join(wanted, "term").join(index.weights(), "term").join(index.norms, "key")
    dots = held.groupBy("query_id", "key").agg(F.round(F.sum(F.col("qw") * (1 + F.log(F.col("n").cast("double"))) * F.col("idf") / F.col("norm")), digits).alias("score"))
    return R.top_k(dots, "query_id", ties, "score", k)
