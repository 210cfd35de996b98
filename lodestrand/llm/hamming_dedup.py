"""MinHash near-duplicates by a multi-index Hamming join.

Each set of shingles gets a signature of LANES minimum hashes, cut down to b bits a lane.  Two signatures
whose distance (lanes that differ) is at most ``most_different(percent)`` must, by the pigeonhole principle, have
one of more than half as many chunks with at most one differing lane.  So each chunk is entered in the
index once for every choice of that many lanes left out (the allowed errors), and every pair within the
distance meets in a bucket, without exception.  Buckets only tie their members to the bucket's smallest
member; the components of those ties are clusters that hold every such pair.

Links are then confirmed on full sets.  A cluster is small as a rule and one task compares its members;
a large one is cut into blocks by set size and hash, and tasks compare pairs of blocks, of sizes that can
reach the similarity at all.  A task returns a spanning forest of its links, never all pairs, and the
components of these links are the result.

Copies (equal sets) are one node from the start, so a text that a third of all rows repeat costs as much as
one row.

Defined results: ids may be numbers or strings; very long texts are blocks of their own; a null, empty or blank text has an empty set and is linked with nothing; a null id is the
last to be chosen as a component's id; rows with equal ids and texts share a component; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.blocks import Block, blocks, mix, window_heads, windows
from lodestrand.llm.common import stored, text_batches
from lodestrand.llm.components import components, roots

SHINGLE = 5
#: Lanes of 16 bits; of pairs at the least similarity that is linked, one in MISSED at most is no candidate.
LANES, MISSED = 40, 8000
#: links: 100 * intersection >= PERCENT * union
PERCENT = 85
#: A task compares blocks of about so many sets and shingles, two at once.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000



def most_different(percent: int) -> int:
    """Lanes that may differ: more do for one pair in MISSED at most whose similarity is ``percent`` hundredths."""
    same = percent / 100
    more = lambda k: sum(comb(LANES, i) * (1 - same) ** i * same ** (LANES - i) for i in range(k + 1, LANES + 1))
    return next(k for k in range(1, LANES) if more(k) * MISSED <= 1)


#: At a similarity of 0.85: 15 of 40 lanes.
MOST_DIFFERENT = most_different(PERCENT)

_FACTORS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a block, by document, and where each document's begin.

    A document with fewer words than a shingle has its whole sequence as the only one; without words, none.
    """
    words = block.hashes()
    heads = np.flatnonzero(window_heads(block, size))
    keys, docs = windows(words, size)[heads] if len(heads) else np.empty(0, np.uint64), block.doc_of_word[heads]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < size))
    if len(short):
        whole = np.array([int(mix(np.uint64([len(w)]) + windows(w, len(w)))[0]) for w in (words[block.word_offs[i] : block.word_offs[i + 1]] for i in short)], np.uint64)
        keys, docs = np.concatenate([keys, whole]), np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[first], docs[first]
    return keys, np.searchsorted(docs, np.arange(len(block) + 1))


def signatures(keys: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """LANES minimum hashes of each set, the low 16 bits of each; zeros for empty sets."""
    out = np.zeros((len(offs) - 1, LANES), np.uint16)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        for lane, factor in enumerate(_FACTORS):
            out[full, lane] = mix(np.minimum.reduceat(keys * factor, offs[full])).astype(np.uint16)
    return out


def chunk_lanes(most: int = MOST_DIFFERENT) -> list[list[int]]:
    """For each entry in the index, the lanes that make its key, so that pairs with ``most`` differing lanes meet."""
    from itertools import combinations

    chunks = most // 2 + 1
    cuts = np.linspace(0, LANES, chunks + 1).astype(int)
    errors = most // chunks
    return [[x for x in range(a, b) if x not in out] for a, b in zip(cuts, cuts[1:], strict=False) for out in combinations(range(a, b), errors)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text_key, text -> id, text_key, n_shingles, set_key, signature."""
    for batch in batches:
        for block in blocks(batch.column(2)):
            keys, offs = shingle_sets(block)
            size = np.diff(offs)
            sums = np.zeros(len(keys) + 1, np.uint64)
            np.cumsum(mix(keys), out=sums[1:])
            set_key = mix(sums[offs[1:]] - sums[offs[:-1]] + mix(size.astype(np.uint64)))
            lanes = signatures(keys, offs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(block.first, len(block)) for i in (0, 1)), pa.array(size.astype(np.int64)), pa.array(set_key.view(np.int64)), pa.array([x.tobytes() for x in lanes], pa.binary())],
                names=["id", "text_key", "n_shingles", "set_key", "signature"],
            )


def _entries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """set_key, signature -> bucket, set_key."""
    lanes = chunk_lanes(most)
    for batch in batches:
        for first in range(0, len(batch), 4000):
            part = batch.slice(first, 4000)
            if not len(part):
                continue
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, LANES).astype(np.uint64)
            buckets = np.empty((len(part), len(lanes)), np.uint64)
            for i, chosen in enumerate(lanes):
                key = np.full(len(part), i + 1, np.uint64)
                for lane in chosen:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, lane])
                buckets[:, i] = key
            who = np.repeat(part.column(0).to_numpy(), len(lanes))
            yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1).view(np.int64)), pa.array(who)], names=["bucket", "set_key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_key, part, text -> set_key, part, shingles."""
    for batch in batches:
        for block in blocks(batch.column(2)):
            keys, offs = shingle_sets(block)
            cols = [batch.column(i).slice(block.first, len(block)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([keys[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["set_key", "part", "shingles"])


def links(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Marks the pairs of sets (rows and columns of a square) with 100 * intersection >= percent * union."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(at)
    shared = held > 1  # what one set alone holds is in no intersection
    column = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(n), size)
    live = shared[at]
    rows, cols = rows[live], column[at[live]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common, width = np.zeros((n, n), np.float32), max(256, 4_000_000 // n)
    for low in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [low, low + width])
        grid = np.zeros((n, width), np.float32)
        grid[rows[a:b], cols[a:b] - low] = 1
        common += grid @ grid.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _compare(part: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the links inside one part, or between its two blocks (both are compared as one)."""
    keys = part["set_key"].to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part["shingles"]]
    a, b = np.nonzero(np.triu(links(sets, percent), 1))
    nodes, low = roots(keys[a], keys[b]) if len(a) else (keys[:0], keys[:0])
    off = nodes != low
    return pa.table({"u": nodes[off], "v": low[off]})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(``doc_id``, n_shingles, component_id, kept) for every row.

    component_id: the smallest id of all rows linked to this one, over any number of links; kept: it is this row's own.
    Shuffles: index entries (16 bytes each), whole texts once, sets of clustered texts.
    """
    text_batches(docs)
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text"))
    id_type = dict(src.dtypes)["id"]
    rows = stored(src.mapInArrow(_describe, f"id {id_type}, text_key long, n_shingles long, set_key long, signature binary"))
    classes = stored(rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "text_key")).alias("of"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")))

    most = most_different(percent)
    entries = classes.select("set_key", "signature").mapInArrow(lambda batches: _entries(batches, most), "bucket long, set_key long")
    heads = entries.groupBy("bucket").agg(F.min("set_key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = entries.join(heads, "bucket").where("set_key <> head")
    clusters = stored(components(ties, "set_key", "head").withColumnsRenamed({"node": "set_key", "root": "cluster"}).join(classes.select("set_key", "of", "n"), "set_key"))

    # Parts: a whole cluster, or pairs of blocks of a large one.  band: sets whose sizes differ by two bands can't be linked.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    banded = clusters.withColumn("band", band)
    per_band = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    blocks_of = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    plan = per_band.groupBy("cluster").agg(
        ((F.sum("sets") <= 2 * BLOCK_SETS) & (F.sum("shingles") <= 2 * BLOCK_SHINGLES)).alias("whole"),
        F.map_from_entries(F.collect_list(F.struct("band", blocks_of.alias("blocks")))).alias("blocks"),
    )
    own = F.pmod(F.xxhash64("set_key"), F.expr("try_element_at(blocks, band)")).cast("int")
    across = lambda step: f"if(try_element_at(blocks, band + {step}) is null, array(), transform(sequence(0, try_element_at(blocks, band + {step}) - 1), k -> "
    parts = F.when(F.col("whole"), F.array(F.lit("all"))).otherwise(
        F.expr(
            "concat("
            + across(0) + "concat_ws(' ', 'in', band, least(own, k), greatest(own, k)))), "
            + across(1) + "concat_ws(' ', 'up', band, own, k))), "
            + across(-1) + "concat_ws(' ', 'up', band - 1, k, own))))"
        )
    )
    placed = banded.join(plan, "cluster").withColumn("own", own).select("set_key", "of", F.transform(parts, lambda p: F.concat_ws(" ", F.col("cluster"), p)).alias("parts"))

    # Each clustered set once, from one row that has it.
    texts = src.select(F.struct("id", "text_key").alias("of"), "text")
    sets = texts.join(placed.hint("shuffle_hash"), "of").dropDuplicates(["set_key"]).select("set_key", F.concat_ws(",", "parts").alias("part"), "text").mapInArrow(_sets, "set_key long, part string, shingles binary")
    dealt = sets.select("set_key", F.explode(F.split("part", ",")).alias("part"), "shingles")
    found = dealt.groupBy("part").applyInArrow(lambda part: _compare(part, percent), "u long, v long")

    linked = components(found, "u", "v").withColumnsRenamed({"node": "set_key"})
    labelled = classes.select("set_key", "least_id").join(linked, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least, "root").select("set_key", "component_id")
    out = rows.join(of_class.where("component_id is not null"), "set_key", "left")
    mine = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", mine.alias("component_id"), F.col("id").eqNullSafe(mine).alias("kept"))
