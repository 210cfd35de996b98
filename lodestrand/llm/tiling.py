"""Benchmark decontamination by greedy string tiling.

A document is contaminated if tiles, that is non-overlapping equal runs of at least ``least`` words, cover
enough of a benchmark item, in any order: a passage whose sentences were rearranged is caught like a whole
one.  Every tile holds a seed (a run of SEED words), so a document and an item are only compared if they
share seeds, and only if the item's words under shared seeds could reach the coverage.

Seeds of items mark a bit map of fixed size, which the tasks that scan texts use to drop nearly all runs of
words; what is left joins the items' seeds by an ordinary join, however large the benchmark is.  Texts that
share enough seeds are tiled with the items that they meet: Karp-Rabin hashes find all matches of a search
length, the longest are marked first, and the length halves until ``least``.

Equal texts are tiled once.

Items of SHORTEST to SEED - 1 words have their whole sequence as the only seed, and as the only tile.

Defined results: a null or empty document is clean, with no item; items of fewer words than ``shortest`` are everyday
phrases and matched by nothing; item ids may be numbers or strings; very long documents are tiled whole; of items that cover equally the smallest id is named; rows with null ids are judged like
others and equal rows each get a row; an empty benchmark leaves all clean; an empty table gives an empty
result; clashing names of results are left out of what is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.blocks import Block, blocks, window_heads, windows
from lodestrand.llm.common import stored, text_batches

#: Words in a seed, which is also the least length of a tile.
SEED = 5
#: Words that an item has at least; single words and pairs of words are in clean texts as well.
SHORTEST = 3
#: Share of an item's words that tiles have to cover.
COVERAGE = 0.8
#: The bit map has 2**MAP_BITS bits, which is 16 MB.
MAP_BITS = 27


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences (hashes): (start in doc, start in item, length), none overlapping.

    Longest matches are marked first; of equally long ones the first in the item, then in the document.
    """
    n, m = len(doc), len(item)
    if n < least or m < least:
        return []
    in_doc, in_item, out = np.zeros(n, bool), np.zeros(m, bool), []
    length = m
    while True:
        again = False
        for size, i, j in _scan(doc, item, in_doc, in_item, length):
            if in_item[i : i + size].any() or in_doc[j : j + size].any():
                again = True  # a longer tile took some of it; what is left has to queue anew
                break
            in_item[i : i + size] = True
            in_doc[j : j + size] = True
            out.append((j, i, size))
        if again:
            continue
        if length == least:
            return sorted(out)
        length = max(least, length // 2)


def _scan(doc: np.ndarray, item: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of free words, of at least ``length``: (length, start in item, start in doc), longest first."""
    free_d = _free_heads(in_doc, length)
    free_i = _free_heads(in_item, length)
    if not len(free_d) or not len(free_i):
        return []
    hd, hi = windows(doc, length)[free_d], windows(item, length)[free_i]
    order = np.argsort(hd, kind="stable")
    ranked = hd[order]
    low, high = np.searchsorted(ranked, hi, "left"), np.searchsorted(ranked, hi, "right")
    found = []
    for i, a, b in zip(free_i[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
        for j in free_d[order[a:b]].tolist():
            if i and j and item[i - 1] == doc[j - 1] and not in_item[i - 1] and not in_doc[j - 1]:
                continue  # a part of a match that begins earlier
            k = length
            while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not in_item[i + k] and not in_doc[j + k]:
                k += 1
            found.append((k, i, j))
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def _free_heads(marked: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[: len(marked) - length + 1]) if len(marked) >= length else np.empty(0, np.int64)


def coverage(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> float:
    return sum(t[2] for t in tiles(doc, item, min(least, len(item)))) / len(item) if len(item) else 0.0


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """item, text -> item, seed, times (in the item), bit, size (words of a seed), words (packed): a row for each distinct seed."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = block.hashes()
            for i in range(len(block)):
                own = words[block.word_offs[i] : block.word_offs[i + 1]]
                if len(own) < max(1, shortest):
                    continue
                size = min(SEED, len(own))
                found, times = np.unique(windows(own, size), return_counts=True)
                same = [batch.column(0)[block.first + i].as_py()] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same, batch.column(0).type), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(_bits(found)), pa.array([size] * len(found), pa.int32()), pa.array([own.tobytes()] * len(found), pa.binary())],
                    names=["item", "seed", "times", "bit", "size", "words"],
                )


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = COVERAGE, keep: list[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """Every row with ``contaminated``, the best covering ``item_id`` and its ``coverage`` (nulls where no tiling was needed).

    keep: columns to carry along (all but clashing ones by default).
    """
    results = ("contaminated", "item_id", "coverage")
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results and not c.startswith("__")]
    spark = text_batches(docs)
    named = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item is not null")
    item_type = dict(named.dtypes)["item"]
    items = stored(named.mapInArrow(lambda b: _items(b, shortest), f"item {item_type}, seed long, times long, bit long, size int, words binary"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # SEED values at most
    cells = items.select(F.expr("bit div 64").alias("cell"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mark")).groupBy("cell").agg(F.bit_or("mark").alias("marks"))
    marks = np.zeros(1 << (MAP_BITS - 6), np.int64)  # the table of cells has at most as many lines
    for row in cells.toLocalIterator():
        marks[row.cell] = row.marks
    lookup = spark.sparkContext.broadcast(marks.tobytes())

    def marked(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of a block that may be an item's, and the documents that hold them."""
        seeds, of, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], block.hashes()
        for size in sizes:
            heads = np.flatnonzero(window_heads(block, size))
            found = windows(words, size)[heads] if len(heads) else np.empty(0, np.uint64)
            at = _bits(found)
            live = (np.frombuffer(lookup.value, np.int64)[at >> 6] >> (at & 63)) & 1 == 1
            seeds.append(found[live])
            of.append(block.doc_of_word[heads[live]])
        order = np.argsort(np.concatenate(of), kind="stable")
        return np.concatenate(seeds)[order], np.concatenate(of)[order]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> key, words, seeds that may be an item's; only texts with some."""
        for batch in batches:
            for block in blocks(batch.column(0)):
                found, of = marked(block)
                which = np.unique(of)
                if not len(which):
                    continue
                words = block.hashes()
                cuts = np.searchsorted(of, which)
                lists = [np.unique(x).view(np.int64) for x in np.split(found, cuts[1:])]
                keys = block.spans(block.offs[which], block.offs[which + 1]).view(np.int64)
                packed = [words[block.word_offs[i] : block.word_offs[i + 1]].tobytes() for i in which]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(packed, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["key", "words", "seeds"])

    scanned = stored(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(hits, "key long, words binary, seeds array<long>"))
    # Shared seeds by (text, item): each place of one in the item covers SEED words, so too few can't reach the coverage.
    held = scanned.select("key", F.explode("seeds").alias("seed")).distinct()
    shared = held.join(items.select("seed", "item", "times"), "seed").groupBy("key", "item").agg(F.sum("times").alias("n"))
    lengths = items.groupBy("item").agg(F.first("words").alias("item_words"))
    wanted = shared.join(lengths, "item").where(F.col("n") * SEED * 8 >= F.octet_length("item_words") * share)

    @F.pandas_udf("double")
    def covered(words: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([coverage(np.frombuffer(w, np.uint64), np.frombuffer(i, np.uint64)) for w, i in zip(words, item, strict=True)], dtype="float64")

    texts = scanned.groupBy("key").agg(F.first("words").alias("words"))
    pairs = wanted.join(texts, "key").withColumn("coverage", covered("words", "item_words"))
    best = pairs.groupBy("key").agg(F.min(F.struct((-F.col("coverage")).alias("minus"), "item")).alias("best"))
    judged = stored(best.select("key", (-F.col("best.minus")).alias("coverage"), F.col("best.item").alias("item_id")))

    src = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([f for f in src.schema if f.name != "__text"] + [T.StructField("__key", T.LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Carried columns, text -> carried columns, key; no key for texts without a marked seed."""
        for batch in batches:
            for block in blocks(batch.column(len(carried))):
                none = np.ones(len(block), bool)
                none[marked(block)[1]] = False
                keys = block.spans(block.offs[:-1], block.offs[1:]).view(np.int64)
                cols = [batch.column(i).slice(block.first, len(block)) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(keys, mask=none)], names=schema.names)

    # Nearly all rows have no key and need no join; their texts are never shuffled.
    out = src.mapInArrow(keyed, schema)
    free = out.where("__key is null").select(*[F.col(f"`{c}`") for c in carried], F.lit(None).cast("double").alias("coverage"), F.lit(None).cast(item_type).alias("item_id"))
    met = out.where("__key is not null").join(judged.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    out = free.unionByName(met)
    flag = F.coalesce(F.col("coverage") >= share, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in carried], flag.alias("contaminated"), "item_id", "coverage")
