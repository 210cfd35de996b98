"""Passages that repeat across documents, by sparse suffixes and exact windows.

Suffixes are retained only where a document's words have a minimiser: the run of RUN words whose hash is
least among WINDOW successive runs.  Equal passages have equal minimisers, wherever they stand, so a
passage of RUN + WINDOW - 1 words or more has a retained suffix in every copy.

A window is ``least`` successive words.  Two documents that share a window share all its minimisers, so
suffixes are counted by run first, and only windows whose minimisers at both ends also occur in another
document are candidates.  These are grouped by a 64-bit hash of their words: a window is shared if it occurs in two
documents.  Spans are the unions of shared windows, that is, of all passages of at least ``least`` words,
merged where they touch or overlap.  No candidate is compared with a chosen neighbour only, so none hides another.

Both groupings keep the least and the greatest document of a hash, so what a third of all documents hold is
added up before any shuffle; the joins back to the rows split such a hash over tasks.

Equal texts are represented by one; if several rows share a text of at least ``least`` words, all of it is
a passage.  What repeats within one document only is none.

Defined results: ids may be numbers or strings; null, empty and short texts have no passage; equal rows get equal spans (they repeat each
other); rows with null ids are reported with null; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.blocks import Block, blocks, mix, window_heads, windows
from lodestrand.llm.common import stored, text_batches

#: Words in a run; runs in a window; words that a passage has at least.
RUN, WINDOW, LEAST = 25, 25, 50


def least_runs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs at all word positions of a block, position of the least of the WINDOW runs from each on)."""
    heads = window_heads(block, RUN)
    runs = np.full(len(heads), np.iinfo(np.uint64).max, np.uint64)
    found = windows(block.hashes(), RUN)
    runs[: len(found)] = found
    runs[~heads] = np.iinfo(np.uint64).max
    # least run of each window, by doubling; windows stay within a document
    n = len(runs)
    place = np.arange(n)
    best = place.copy()
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        other = np.minimum(place + step, n - 1)
        right = best[other]
        best = np.where(runs[right] < runs[best], right, best)
        width += step
    return runs, best


def minimisers(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word positions in the block, hashes of their runs, documents) of all minimisers of a block."""
    empty = np.empty(0, np.int64)
    heads = window_heads(block, RUN)
    if not heads.any():
        return empty, empty.astype(np.uint64), empty
    runs, best = least_runs(block)
    place = np.arange(len(runs))
    last = np.repeat(block.word_offs[1:], block.n_words) - RUN - WINDOW + 1  # where the last full window begins
    first = np.repeat(block.word_offs[:-1], block.n_words)
    full = place <= np.maximum(last, first)  # a document with fewer runs than a window counts as one
    chosen = np.unique(best[full & heads])
    chosen = chosen[heads[chosen]]
    return chosen, runs[chosen], block.doc_of_word[chosen]


def _suffixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """text -> run, key, pos (words from the text's start); texts of fewer than ``least`` words have none."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            at, runs, docs = minimisers(block)
            long = block.n_words[docs] >= least
            at, runs, docs = at[long], runs[long], docs[long]
            if len(at):
                keys = block.spans(block.offs[:-1], block.offs[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (runs.view(np.int64), keys[docs], (at - block.word_offs[docs]).astype(np.int32))], names=["run", "key", "pos"])


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """text, key, places of minimisers that other documents have too -> window, key, start of all candidates."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            part = batch.slice(block.first, len(block))
            keys, lists = part.column(1).to_numpy(), part.column(2)
            places = lists.flatten().to_numpy() + np.repeat(block.word_offs[:-1], lists.value_lengths().to_numpy())
            met = np.zeros(len(block.doc_of_word), bool)
            met[places] = True
            at = np.flatnonzero(window_heads(block, least))
            if not len(at):
                continue
            _, best = least_runs(block)
            at = at[met[best[at]] & met[best[at + least - RUN - WINDOW + 1]]]
            docs = block.doc_of_word[at]
            found = windows(block.hashes(), least)[at]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(keys[docs]), pa.array((at - block.word_offs[docs]).astype(np.int32))], names=["window", "key", "start"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, key, n_words."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            key = block.spans(block.offs[:-1], block.offs[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(key.view(np.int64)), pa.array(block.n_words.astype(np.int64))], names=["id", "key", "n_words"])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, key, text."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            key = block.spans(block.offs[:-1], block.offs[1:])
            same = [batch.column(i).slice(block.first, len(block)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(key.view(np.int64)), same[1]], names=["id", "key", "text"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(``doc_id``, start, end, n_words): spans of words, from 0 and end exclusive, that other documents hold as well.

    Shuffles: retained suffixes twice (about a twelfth of all words, 20 bytes each), texts with candidates once,
    candidate windows twice (20 bytes each).
    """
    if not RUN + WINDOW - 1 <= least:
        raise ValueError(f"least has to be {RUN + WINDOW - 1} or more")
    text_batches(docs)
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = dict(src.dtypes)["id"]
    rows = stored(src.mapInArrow(_keyed, f"id {id_type}, key long, n_words long").where(F.col("n_words") >= least))
    keys = rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n_words").alias("n_words"))

    def met(rows: DataFrame, by: str) -> DataFrame:
        """Rows whose value of ``by`` occurs in two documents or more."""
        # written first: a join splits a frequent value over tasks only if both of its sides come straight from a shuffle
        several = stored(rows.groupBy(by).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(by))
        return rows.join(several.hint("merge"), by, "left_semi")

    suffixes = src.select("text").mapInArrow(lambda batches: _suffixes(batches, least), "run long, key long, pos int")
    wanted = met(stored(suffixes), "run").groupBy("key").agg(F.collect_set("pos").alias("places"))
    of = wanted.join(keys.select("key", "id"), "key").select(F.struct("id", "key").alias("of"), "places")
    texts = src.mapInArrow(_with_key, f"id {id_type}, key long, text string").select(F.struct("id", "key").alias("of"), "text")
    once = texts.join(of.hint("shuffle_hash"), "of").dropDuplicates(["of"])
    candidates = stored(once.select("text", "of.key", "places").mapInArrow(lambda batches: _windows(batches, least), "window long, key long, start int"))
    single = met(candidates, "window").select("key", "start", (F.col("start") + least).alias("end"))
    copied = keys.where("copies > 1").select("key", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
    # overlapping spans of a text become one
    along = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = single.union(copied).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = rows.select("id", "key").join(merged, "key")
    return out.select(F.col("id").alias(doc_id), "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
