"""Quality rules: compression bands.

A text that repeats itself compresses too well, and random or encoded text hardly at all.  Each text is
compressed with zstandard as a whole and in fixed chunks, and the ratio (bytes before / bytes after) has
to lie in a band that depends on the length, since short texts never compress well.  All bands are
parameters; they were set well outside what natural prose of each length reaches.  The lower limits lie between
base64 (at most 1.03, 1.11, 1.18, 1.27, 1.33 and 1.35 in texts to 192, 256, 512, 1,024, 4,096 bytes and beyond) and prose (1.08,
1.21, 1.34, 1.43, 1.69 and 2.09 at least in sf0.1; chunks 1.31 and 1.89).  In texts of up to 128 bytes the two compress alike, and
hex digits compress as short prose does (1.53 to 1.96), so ratios can't tell them apart.

Chunks follow each other from the text's start; what is left at the end is judged with the bytes before it, as the
text's last chunk of full length.  A text shorter than a chunk is one chunk, which the band of its length judges.

Defined results: a null text has no words and fails the base rule; an empty text likewise; nulls in other
columns are carried along; repeated rows are judged one by one; an empty table gives an empty result;
columns of the input that clash with the names of results are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.blocks import Block, blocks, mix, window_heads, windows
from lodestrand.llm.common import text_batches

#: (texts of up to so many bytes, least ratio, largest ratio) of whole texts.
WHOLE_BANDS = ((64, 0.0, 9e9), (128, 0.0, 3.2), (192, 1.05, 3.2), (256, 1.14, 3.2), (512, 1.22, 3.6), (1024, 1.34, 3.6), (4096, 1.5, 4.2), (1 << 16, 1.6, 5.0), (1 << 62, 1.6, 8.0))
#: Bytes in a chunk; the band of chunks; the share of a text's chunks that may lie outside it.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 2048, (1.5, 4.2), 0.25
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, chunk_share double, base_failed boolean, kept boolean"


def _repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the entries whose key occurs in the same document before, and those whose key occurs there twice or more."""
    mixed = keys ^ mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return later, any_


def _dup_lines(block: Block) -> np.ndarray:
    data, offs = block.data, block.offs
    breaks = np.flatnonzero(data == 10)
    docs = np.searchsorted(offs, breaks, "right") - 1
    full = np.flatnonzero(np.diff(offs) > 0)
    starts = np.concatenate([offs[full], breaks + 1])
    ends = np.concatenate([breaks, offs[full + 1]])
    # by document first: where one ends with a line break, its last, empty line begins where the next document does
    order = np.lexsort((starts, np.concatenate([full, docs])))
    ends = ends[np.lexsort((ends, np.concatenate([docs, full])))]
    starts, of = starts[order], np.concatenate([full, docs])[order]
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~np.isin(data, np.array([0x20, *range(9, 14)], np.uint8)), out=worded[1:])
    live = (ends > starts) & (worded[ends] > worded[starts])
    starts, ends, of = starts[live], ends[live], of[live]
    later, _ = _repeats(block.spans(starts, ends), of)
    return np.bincount(of[later], minlength=len(block))


def _repeat_words(block: Block) -> np.ndarray:
    heads = np.flatnonzero(window_heads(block, 5))
    if not len(heads):
        return np.zeros(len(block), np.int64)
    keys = windows(block.hashes(lower=False), 5)[heads]
    _, twice = _repeats(keys, block.doc_of_word[heads])
    edge = np.zeros(len(block.doc_of_word) + 1, np.int64)
    np.add.at(edge, heads[twice], 1)
    np.add.at(edge, heads[twice] + 5, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(block.doc_of_word[covered], minlength=len(block))


def _ratios(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its chunks outside the band; the last one ends with the text."""
    if not text:
        return 1.0, 0.0
    whole = len(text) / len(press.compress(text))
    if len(text) < CHUNK_BYTES:
        return whole, 0.0
    starts = [*range(0, len(text) - CHUNK_BYTES, CHUNK_BYTES), len(text) - CHUNK_BYTES]
    low, high = CHUNK_BAND
    out = sum(not low <= CHUNK_BYTES / len(press.compress(text[i : i + CHUNK_BYTES])) <= high for i in starts)
    return whole, out / len(starts)


def measure(block: Block, whole_bands=WHOLE_BANDS, chunk_share=CHUNK_SHARE) -> dict[str, np.ndarray]:
    """All figures of a block of texts, by column."""
    starts, ends = block.words
    inside = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    n_words, n_repeat = block.n_words, _repeat_words(block)
    press = zstandard.ZstdCompressor(level=LEVEL)
    ratios = np.array([_ratios(block.text(i), press) for i in range(len(block))]).reshape(-1, 2)
    size = np.diff(block.offs)
    band = np.searchsorted([b[0] for b in whole_bands], size)
    low, high = np.array([b[1] for b in whole_bands])[band], np.array([b[2] for b in whole_bands])[band]
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    fits = (ratios[:, 0] >= low) & (ratios[:, 0] <= high) & (ratios[:, 1] <= chunk_share)
    return {
        "n_words": n_words, "word_chars": block.counts(inside & ((block.data & 0xC0) != 0x80)), "n_symbols": block.counts(_SYMBOL[block.data]),
        "n_dup_lines": _dup_lines(block), "n_repeat_words": n_repeat, "whole_ratio": ratios[:, 0], "chunk_share": ratios[:, 1], "base_failed": failed, "kept": fits & ~failed,
    }


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, whole_bands=WHOLE_BANDS, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """Add the figures and the verdict ``kept`` to every row.

    keep: columns to carry along (all others than the results' by default).  No shuffle: one pass over the texts.
    """
    text_batches(docs)
    made = T._parse_datatype_string(FIELDS)
    names = {f.name.lower() for f in made}
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    src = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([f for f in src.schema if f.name != "__text"] + list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(len(carried))):
                found = measure(block, whole_bands, chunk_share)
                cols = [batch.column(i).slice(block.first, len(block)) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(found[f.name]) for f in made)], names=schema.names)

    return src.mapInArrow(run, schema)
