"""Alignment of two tokenizers through inverted pair bitmaps.

Both tokenizers cut the same bytes; where tokens of both end together, the last token of each is a link.  How good a link is follows from
how often its pair of ids is linked in the corpus, for which pairs are indexed:

* Tasks that read texts number the documents of a block (up to 65,536) and write, for each pair of ids in the block, one bitmap for each
  binary digit of how often a document has the pair: its multiplicity planes.  A bitmap is a list of 16-bit places
  while it is short and 65,536 bits otherwise.
* The planes of a pair and block, or-ed, are its documents; popcounts of this and of the planes, weighted by 2**digit, are
  summed over blocks to how many documents and links each pair has; the largest number of links of each B id is its best.
* Joined with these sums, the same postings go back to their block, where each adds its pair's count to the documents in its planes.

Texts are cut into units that begin with a space (``spaced``), where both tokenizers end a token, so a distinct unit is encoded and aligned
once while a task remembers it.  Nothing grows in one place: a pair has a line a block, a block holds ``BLOCK_BYTES`` of text or one document.

Defined results: texts that are null or empty, or that a tokenizer doesn't give back byte for byte after a space, have no tokens: zeros and an
empty digest; names of special tokens inside a text are ordinary text; repeated rows count as often as they occur; a null id is carried along;
very long texts are encoded a slice at a time; other columns aren't read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.byte_bpe import encoder, letters
from lodestrand.llm.common import small_batches, stored
from lodestrand.llm.spaced import Units

#: A pair is a << ID_BITS | b.
ID_BITS = 20
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: A bitmap of so many documents or more is 65,536 bits.
DENSE = 4096
POSTINGS = "block long, pair long, planes array<binary>"
#: Bytes, their number and the decimal name of each id.
Known = dict[int, tuple[bytes, int, str]]
DOCS = "n_a long, n_b long, n_groups long, groups_sha256 string, place int"


@lru_cache(maxsize=2)
def _units(path_a: str, path_b: str) -> Units:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, ids = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), encoder(path_a)
    byte = letters()
    bytes_a = {i: bytes(byte[c] for c in token) for token, i in a.get_vocab().items() if all(c in byte for c in token)}
    bytes_b = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))}
    if max(*bytes_a, *bytes_b) >> ID_BITS:
        raise ValueError(f"ids of more than {ID_BITS} bits")
    known_a, known_b = ({i: (data, len(data), str(i)) for i, data in known.items()} for known in (bytes_a, bytes_b))

    def align(units: list[str]) -> list[tuple[bytes, bytes, int, int] | bool]:
        """(groups, links, ids of A, ids of B) of each unit; False where its bytes don't come back."""
        return [aligned(unit.encode(), ids(unit), y, known_a, known_b) for unit, y in zip(units, b.encode([u[1:] for u in units], num_threads=1), strict=True)]

    return Units(align)


def aligned(text: bytes, ids_a: list[int], ids_b: list[int], known_a: Known, known_b: Known) -> tuple[bytes, bytes, int, int] | bool:
    """Groups as text, and links as 64-bit pairs; False where one of the tokenizers doesn't give the text back."""
    of_a, of_b = [known_a[i] for i in ids_a], [known_b[i] for i in ids_b]
    if b"".join([x[0] for x in of_a]) != text or b"".join([x[0] for x in of_b]) != text:
        return False
    names_a, names_b = [x[2] for x in of_a], [x[2] for x in of_b]
    ends = dict(zip(accumulate([x[1] for x in of_b]), range(1, len(ids_b) + 1), strict=True))
    groups, links, first_a, first_b = [], [], 0, 0
    for k, end in enumerate(accumulate([x[1] for x in of_a]), 1):
        if j := ends.get(end):
            groups.append(f"{','.join(names_a[first_a:k])}|{','.join(names_b[first_b:j])}")
            links.append(ids_a[k - 1] << ID_BITS | ids_b[j - 1])
            first_a, first_b = k, j
    return ";".join(groups).encode(), struct.pack(f"<{len(links)}q", *links), len(ids_a), len(ids_b)


def _document(text: str, units: Units) -> tuple[int, int, str, bytes]:
    """(ids of A, ids of B, digest of the groups, links) of a text."""
    n_a = n_b = 0
    digest, links = hashlib.sha256(), []
    for values in units.of(text):
        if False in values:
            return 0, 0, "", b""
        if links:
            digest.update(b";")
        digest.update(b";".join([v[0] for v in values]))
        links.append(b"".join([v[1] for v in values]))
        n_a += sum([v[2] for v in values])
        n_b += sum([v[3] for v in values])
    return n_a, n_b, digest.hexdigest() if links else "", b"".join(links)


def bitmaps(pairs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct pairs, and the multiplicity planes of each, from the pair and the document of each link."""
    key, times = np.unique(pairs << 16 | places, return_counts=True)
    digits = int(times.max(initial=0)).bit_length()
    marked = [np.flatnonzero(times >> k & 1) for k in range(digits)]
    order = np.concatenate([key[m] >> 16 for m in marked]) * 64 + np.repeat(np.arange(digits), [len(m) for m in marked]) if digits else key
    rows = np.argsort(order, kind="stable")
    order, data = order[rows], (np.concatenate([key[m] & 0xFFFF for m in marked])[rows] if digits else key).astype("<u2")
    starts = np.flatnonzero(np.diff(order, prepend=-1))
    raw, edges = data.tobytes(), [*starts.tolist(), len(data)]
    out: list[list[bytes]] = []
    last = -1
    for code, i, j in zip(order[starts].tolist(), edges, edges[1:], strict=False):
        if code >> 6 != last:
            last = code >> 6
            out.append([])
        planes = out[-1]
        planes += [b""] * ((code & 63) - len(planes))
        planes.append(raw[2 * i : 2 * j] if j - i < DENSE else _dense(data[i:j]))
    return np.unique(order >> 6), out


def _dense(places: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK_DOCS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def members(bitmap: bytes) -> np.ndarray:
    """Places that a bitmap marks."""
    if len(bitmap) == BLOCK_DOCS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


def popcount(planes: list[bytes]) -> tuple[int, int]:
    """(documents, links) of the planes of a pair and block."""
    sizes = [int(np.bitwise_count(np.frombuffer(p, np.uint8)).sum()) if len(p) == BLOCK_DOCS // 8 else len(p) // 2 for p in planes]
    links = sum(n << k for k, n in enumerate(sizes))
    if len([n for n in sizes if n]) < 2:
        return sum(sizes), links
    union = np.zeros(BLOCK_DOCS // 64, np.uint64)
    for p in planes:
        union |= np.frombuffer(p if len(p) == BLOCK_DOCS // 8 else _dense(np.frombuffer(p, "<u2")), np.uint64)
    return int(np.bitwise_count(union).sum()), links


def index(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (without a pair) and of postings (with one), by block."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string(f"{DOCS}, {POSTINGS}")])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())]

    def rows(block: int, ids: list[pa.Array], found: list[tuple[int, int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        n, n_links = len(found), np.array([len(f[3]) // 8 for f in found])
        columns = [[f[0] for f in found], [f[1] for f in found], n_links, [f[2] for f in found], np.arange(n), np.full(n, block)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), pa.nulls(n, kinds[6]), pa.nulls(n, kinds[7])], names=schema.names)
        pairs, planes = bitmaps(np.frombuffer(b"".join([f[3] for f in found]), "<i8"), np.repeat(np.arange(n), n_links))
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            empty = [pa.nulls(len(part), k) for k in (ids[0].type, *kinds[:5])]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(len(part), block), kinds[5]), pa.array(part, kinds[6]), pa.array(planes[at : at + 50_000], kinds[7])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, block = _units(path_a, path_b), TaskContext.get().partitionId() << 24
        ids, found, size = [], [], 0
        for batch in batches:
            first = 0
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py() or ""
                found.append(_document(text, units))
                size += len(text)
                if size >= block_bytes or len(found) == BLOCK_DOCS:
                    yield from rows(block, [*ids, batch.column(0).slice(first, i + 1 - first)], found)
                    ids, found, size, first, block = [], [], 0, i + 1, block + 1
            if first < len(batch):
                ids.append(batch.column(0).slice(first))
        if found:
            yield from rows(block, ids, found)

    return src.mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): documents and links of each pair, and whether no pair of its B id has more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([popcount(p) for p in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["pair", "n_docs", "n_links"])

    sums = postings.select("pair", "planes").mapInArrow(run, "pair long, n_docs long, n_links long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    most = F.max("n_links").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1)))  # at most as many pairs as A has ids
    return sums.withColumn("best", F.col("n_links") == most)


def scores(docs: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of documents with ``n_best`` and ``count_sum``, gathered from the postings of their block."""
    scored = postings.join(counts.select("pair", "n_links", "best"), "pair").select(F.col("block").alias("at"), "planes", "n_links", "best")
    schema = T.StructType([f for f in docs.schema if f.name not in ("block", "place")] + T._parse_datatype_string("n_best long, count_sum long").fields)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        total, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for batch in found.to_batches(max_chunksize=20_000):
            links, top = batch.column("n_links").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            sparse: list[tuple[int, int, bytes]] = []
            for i, planes in enumerate(batch.column("planes").to_pylist()):
                for k, p in enumerate(planes):
                    if len(p) == BLOCK_DOCS // 8:
                        at = members(p)
                        total[at] += links[i] << k
                        best[at] += int(top[i]) << k
                    elif p:
                        sparse.append((i, k, p))
            at = np.frombuffer(b"".join([p for _, _, p in sparse]), "<u2").astype(np.int64)
            n = [len(p) // 2 for _, _, p in sparse]
            i, k = np.repeat([x[0] for x in sparse], n).astype(np.int64), np.repeat([x[1] for x in sparse], n).astype(np.int64)
            np.add.at(total, at, links[i] << k)
            np.add.at(best, at, top[i].astype(np.int64) << k)
        order = own["place"].to_numpy()
        own = own.select([f.name for f in schema if f.name in own.column_names])
        return own.append_column("n_best", pa.array(best[order])).append_column("count_sum", pa.array(total[order]))

    return docs.groupBy("block").cogroup(scored.groupBy("at")).applyInArrow(run, schema)


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    with small_batches(docs.sparkSession):
        built = stored(index(docs, path_a, path_b, doc_id, text))
    postings = built.where("pair is not null").select("block", "pair", "planes")
    own = built.where("pair is null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    found = scores(own, postings, pair_counts(postings))
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
