"""Best-fit packing planned over a histogram of lengths.

Each text becomes token ids and an end; what is longer than a sequence is cut from the end into full pieces, so the first piece takes what
is left over.  Packing depends on the lengths alone, so it is planned over how many pieces have each length: longest first, each length goes to the
sequences with the least room that is enough.  Sequences filled alike are one line of the plan, a range of sequence numbers, which is
split when only a part of it takes the next length.  Pieces of a length are then ranked, and each takes the slot that the plan has for its rank.

Ranks are taken in hash ranges of rows and offset by the counts of the ranges before, so a length that a third of all pieces have isn't
numbered in one task.  What is broadcast is the plan, a few lines for each length, and the counts of the ranges, one line for about RANGE_ROWS
pieces.  A range's rows meet in one exchange and are ranked where they arrive, by numpy: Spark's sort and window took a page of tens of
megabytes in each task, however few rows it had, and an executor's heap grew with the number of tasks.

Defined results: names of special tokens inside a text are ordinary text; a null or empty text is one piece that holds the end only; repeated rows are packed one by one; a text longer than a
sequence, however long, takes as many sequences as it fills and its first piece shares one; a null id is carried along; other columns aren't
read, so none can clash; an empty table gives an empty result.  Of the same rows Spark may give equal lengths to other slots when it
deals them to tasks differently; the number of sequences stays the same.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.blocks import mix
from lodestrand.llm.byte_bpe import encoder
from lodestrand.llm.common import small_batches, stored
from lodestrand.llm.spaced import slices

SEQUENCE = 1024
END = 2
#: Pieces that share a hash range of a length, about; a task numbers such a range at once.
RANGE_ROWS = 20_000
#: Ranks within a length stay below 2**RANK_BITS.
RANK_BITS = 46
#: Rows of a batch of the result.
PLACED_ROWS = 10_000


def plan(counts: Mapping[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first: (length, first rank, pieces, first sequence, pieces a sequence, offset of the first piece in its sequence)."""
    lines, sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)

    def put(length: int, rank: int, first: int, n: int, each: int, left: int) -> None:
        lines.append((length, rank, n * each, first, each, size - left))
        if left - each * length:
            room[left - each * length].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, total = 0, counts[length]
        for left in range(length, size + 1):
            while rank < total and (room[left] if left < size else True):
                fit = left // length
                # at room for a whole sequence: new ones
                first, n = room[left].pop() if left < size else (sequences, -(-(total - rank) // fit))
                full = min(n, (total - rank) // fit)
                if full:
                    put(length, rank, first, full, fit, left)
                    rank += full * fit
                if full < n and rank < total:  # one more takes fewer
                    put(length, rank, first + full, 1, total - rank, left)
                    full, rank = full + 1, total
                if left == size:
                    sequences += n
                elif full < n:
                    room[left].append((first + full, n - full))
    return sorted(lines)


def encoded(text: str | None, ids: Callable[[str], list[int]], end: int = END) -> bytes:
    """Ids of a text and the end, as little-endian unsigned 32-bit integers."""
    return b"".join(np.array(ids(part), "<u4").tobytes() for part in slices(text or "")) + end.to_bytes(4, "little")


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row) of every piece of every text; ``row`` differs between any two pieces."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string("piece int, start long, length int, ids_crc32 long, row long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            of, rows = [], []
            for i in range(len(batch)):
                data = encoded(batch.column(1)[i].as_py(), ids, end)
                n = len(data) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(i)
                    rows.append((k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), row))
                    row += 1
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int = END, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, vocabulary, doc_id, text, size, end))
    counts = {length: n for length, n in cut.groupBy("length").count().collect()}  # a line for each length up to ``size``
    ranges = [1 << (counts.get(k, 0) // range_rows).bit_length() for k in range(size + 1)]
    ranged = cut.withColumn("range", F.pmod(F.xxhash64("row"), F.element_at(F.lit(ranges), F.col("length") + 1)).cast("int"))
    tally = np.array(sorted(map(tuple, ranged.groupBy("length", "range").count().collect())), np.int64).reshape(-1, 3)  # a line for each range
    before = np.cumsum(tally[:, 2]) - tally[:, 2]
    before -= before[np.searchsorted(tally[:, 0], tally[:, 0])]  # of the ranges of the same length
    lines = docs.sparkSession.sparkContext.broadcast((np.array(plan(counts, size), np.int64).reshape(-1, 6), (tally[:, 0] << RANK_BITS) + tally[:, 1], before))
    schema = T.StructType([cut.schema["doc_id"], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # some numbers for each piece of whole ranges
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        found, ranges, before = lines.value
        length, key = rows["length"].to_numpy().astype(np.int64), rows["range"].to_numpy().astype(np.int64)
        key += length << RANK_BITS
        order = np.lexsort((mix(rows["row"].to_numpy().astype(np.uint64)), key))
        length, key = length[order], key[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key) + before[np.searchsorted(ranges, key)]
        at = found[np.searchsorted((found[:, 0] << RANK_BITS) + found[:, 1], (length << RANK_BITS) + rank, "right") - 1].T
        step = rank - at[1]
        kept = rows.select(["doc_id", "piece", "start", "ids_crc32"]).take(pa.array(order))
        columns = [kept["doc_id"], kept["piece"], kept["start"], pa.array(length), kept["ids_crc32"], pa.array(at[3] + step // at[4]), pa.array(at[5] + step % at[4] * length)]
        yield from pa.table(columns, names=schema.names).to_batches(max_chunksize=PLACED_ROWS)

    return ranged.repartition("length", "range").mapInArrow(place, schema)
