"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character n-grams (3 to 5 characters, the white space beside a
word included) inside them, hashed into a table of 2**BUCKET_BITS vectors; a word that repeats the one before it
is a feature of its own.  The vectors of all features of a text
are averaged, and a softmax layer turns the average into the odds of each label.  Vectors and layer are
learned by stochastic gradient descent in numpy, a document a step, each step scaled to the document's
feature weights so that long and short texts move the average alike.

Training uses a bounded sample of labelled rows: the SAMPLE ids with the least hashes among those in the
training fold.  One task trains on it and hands back one number for each bucket: with two labels, the layer's
difference times a vector is all that scoring needs.  Scoring is one pass over all texts without a shuffle.

Defined results: a null or empty text, or one without features, scores by the bias alone; without labelled
rows every score is 0.5; labels with null ids or labels are ignored, and of repeated ids the largest label
counts; nulls elsewhere and repeated rows do no harm; texts of any length are scored whole, one of more than a block
by itself; columns other than the id, the text and the label aren't read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.blocks import BASE, SPACE, Block, blocks, mix
from lodestrand.llm.common import id_remainder, text_batches

BUCKET_BITS = 18
GRAMS = (3, 4, 5)
#: The bucket of a word that repeats the word before it.
AGAIN = 0
#: Most labelled rows that training sees.
SAMPLE = 4000
DIMENSIONS, EPOCHS, RATE, SEED = 8, 6, 0.4, 20


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, and where each document's begin."""
    first = (block.data & 0xC0) != 0x80
    if first.all():
        return block.data, block.offs
    sums = np.zeros(len(first) + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    return np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), sums[block.offs]


def _features(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, documents, ascending) for words and for each n-gram size."""
    shift = np.uint64(64 - BUCKET_BITS)
    words = block.hashes(lower=False)
    again = np.flatnonzero((words[1:] == words[:-1]) & (block.doc_of_word[1:] == block.doc_of_word[:-1])) + 1
    out = [((words >> shift).astype(np.int32), block.doc_of_word), (np.full(len(again), AGAIN, np.int32), block.doc_of_word[again])]
    signs, offs = characters(block)
    n = len(signs)
    space = SPACE[np.minimum(signs, 255)]
    codes = mix((np.where(space, 32, signs).astype(np.uint64) + np.uint64(1)) * BASE)
    inner = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=inner[1:])
    doc = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(offs))
    h = codes.copy()
    for size in range(2, GRAMS[-1] + 1):
        m = n - size + 1
        if m <= 0:
            break
        h = h[:m] * BASE + codes[size - 1 :]
        if size in GRAMS:
            # only the first and the last character may be white space, and all are of one document
            live = np.flatnonzero((inner[size - 1 : size - 1 + m] == inner[1 : m + 1]) & (doc[:m] == doc[size - 1 :]))
            g = h[live] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * size)
            out.append((((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int32), doc[live]))
    return out


def score_block(block: Block, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    total, count = np.zeros(len(block)), np.zeros(len(block), np.int64)
    for buckets, docs in _features(block):
        cuts = np.searchsorted(docs, np.arange(len(block) + 1))
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(weights[buckets], out=sums[1:], dtype=np.float64)
        total += sums[cuts[1:]] - sums[cuts[:-1]]
        count += np.diff(cuts)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -50, 50)))


def bags(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares of all features) for each text."""
    parts = _features(block)
    out = []
    cuts = [np.searchsorted(docs, np.arange(len(block) + 1)) for _, docs in parts]
    for i in range(len(block)):
        own, counts = np.unique(np.concatenate([b[c[i] : c[i + 1]] for (b, _), c in zip(parts, cuts, strict=True)]), return_counts=True)
        out.append((own.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the bias, from (buckets, shares, label) of each example."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    layer[:] = rng.normal(0, 1 / DIMENSIONS, layer.shape)
    if not examples:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    step, steps = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            buckets, shares, label = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = shares @ vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            odds /= odds.sum()
            odds[label] -= 1  # gradient by the logits
            back = layer @ odds
            layer -= rate * np.outer(mean, odds)
            bias -= 0.1 * rate * odds
            if len(buckets):
                vectors[buckets] -= np.outer(shares * (rate / max(float(shares @ shares), 1e-6)), back)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, held_out: int) -> tuple[np.ndarray, float]:
    """Train on rows whose id's remainder by ``held_out`` isn't 0."""
    ids = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label in (0, 1)").where(id_remainder("id", held_out) != 0)
    sample = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # at most SAMPLE pairs of numbers
    chosen = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "id").select("id", "text", "label")

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = bags(block)
                cols = [batch.column(i).slice(block.first, len(block)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "label", "buckets", "shares"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(r["id"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for b in batches for r in b.to_pylist()]
        examples.sort(key=lambda e: (e[0], len(e[1])))
        weights, bias = train([e[1:] for e in examples])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    id_type = dict(chosen.dtypes)["id"]
    model = chosen.mapInArrow(bagged, f"id {id_type}, label int, buckets binary, shares binary").repartition(1).mapInArrow(trained, "weights binary, bias double").first()
    return (np.frombuffer(bytes(model.weights), np.float32), model.bias) if model else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: int = 5, threshold: float = 0.3) -> DataFrame:
    """(``doc_id``, held_out, score, predicted) for every row.

    held_out: rows whose crc32(id as text) modulo this is 0 are never trained on; predicted: 1 if score >= threshold.
    """
    text_batches(docs)
    weights, bias = fit(docs, labels, doc_id, text, label, held_out)
    data = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes for each bucket
    src = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([src.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(score_block(block, data.value, bias))], names=schema.names)

    scored = src.mapInArrow(run, schema)
    return scored.select(doc_id, (id_remainder(doc_id, held_out) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
