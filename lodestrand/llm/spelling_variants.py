"""Spelling variants: words one edit apart, found by Gram matrices of blocks of letter counts.

A word is a vector of letter counts.  One replaced letter moves it by a squared distance of 2 at most, one inserted or
deleted letter by 1, so all near words lie within 2.  Words are dealt into blocks by how many letters of three sets they
have (the three numbers add up to the length); an edit moves a word to an adjacent block: the same length or one
more or less, and each number changed by one at most.  Each pair of adjacent blocks is a tile, for which a task multiplies the two
matrices of letter counts; a product gives all squared distances at once.  Inside a tile the same rule on six smaller sets of letters says
which rows need to be multiplied.  What is left is verified letter by letter.

Blocks of more than ``BLOCK_WORDS`` words are dealt into chunks by a hash, and tiles are pairs of chunks, so no task gets more than two
chunks.  A tile returns a line for each word that has a near one, with the number of these and the best, not the pairs.

Runs of letters are counted in the tasks that read the texts: a slice of texts is split by Arrow, each distinct run hashed once, and the
checksum of ``<doc_id>:<run>`` put together from those of its two parts by table, since crc32 is linear.

Defined results: null or empty texts and texts without letters have no words; a null id counts as empty text; repeated rows
count as often as they occur; other columns aren't read, so none can clash; texts of any length are cut into slices between two
runs; of near words that occur equally often the smallest in code-point order is the form; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import stored, text_slices

#: Runs of letters; what is lower-cased is A-Z only.
LETTERS = "a-zÀ-ÿ"
#: One run in so many loses a letter.
EVERY = 31
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Three pairs of sets of letters, all other letters belonging to the last; about as frequent as each other. Any choice gives the same result.
SETS = (("e", "ndg"), ("at", "iob"), ("hrs", ""))
BLOCK_WORDS = 8192
#: Entries of a product made at once.
ENTRIES = 1 << 22
#: Longest run in bytes whose checksum comes from the table.
TABLED = 64


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[byte of a checksum, n, value]: what that byte turns into when n zero bytes follow."""
    out = np.zeros((4, TABLED + 1, 256), np.uint32)
    for n in range(TABLED + 1):
        zero = zlib.crc32(bytes(n), 0)
        for k in range(4):
            out[k, n] = [zlib.crc32(bytes(n), b << (8 * k)) ^ zero for b in range(256)]
    return out


def checksums(prefixes: np.ndarray, words: list[str], which: np.ndarray) -> np.ndarray:
    """crc32 of a text with checksum ``prefixes[i]`` followed by word ``which[i]``, for all i."""
    data = [w.encode() for w in words]
    own, size = np.array([zlib.crc32(d) for d in data], np.uint32), np.array([len(d) for d in data])
    n, table = size[which], _shifts()
    short = np.minimum(n, TABLED)
    out = own[which]
    for k in range(4):
        out ^= table[k, short, (prefixes >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(n > TABLED):
        out[i] = zlib.crc32(data[which[i]], int(prefixes[i]))
    return out


def _count(ids: list[str], texts: pa.Array) -> pa.RecordBatch:
    """(word, n) of a slice of texts; a word may come twice."""
    runs = pc.split_pattern_regex(pc.ascii_lower(texts), f"[^{LETTERS}]+")
    doc = np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy()))
    coded = pc.dictionary_encode(runs.flatten())
    which, length = coded.indices.to_numpy(), pc.utf8_length(coded.dictionary).to_numpy()
    long = length >= LEAST_LENGTH
    place = np.cumsum(long) - 1
    doc, which = doc[long[which]], place[which[long[which]]]
    words, length = coded.dictionary.filter(pa.array(long)), length[long]
    names = words.to_pylist()
    sums = checksums(np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[doc], names, which) if len(which) else np.empty(0, np.uint32)
    cut = sums % np.uint32(EVERY) == 0
    whole = np.bincount(which[~cut], minlength=len(names))
    # (word, place of the letter that goes) as one number
    most = int(length.max(initial=1))
    shorter, times = np.unique(which[cut].astype(np.int64) * most + sums[cut] % length[which[cut]], return_counts=True)
    without = [(names[k // most], k % most) for k in shorter.tolist()]
    without = [w[:i] + w[i + 1 :] for w, i in without]
    left = np.array([len(w) >= LEAST_LENGTH for w in without], bool)
    seen = whole > 0
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([words.filter(pa.array(seen)).cast(pa.string()), pa.array(without, pa.string()).filter(pa.array(left))]), pa.array(np.concatenate([whole[seen], times[left]]), pa.int64())], names=["word", "n"]
    )


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of enough letters, after one run in ``EVERY`` has lost a letter, that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch.column(1), f"[^A-Z{LETTERS}]"):
                yield _count(batch.column(0).take(pa.array(rows)).to_pylist(), texts)

    src = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _fine(codes: np.ndarray) -> np.ndarray:
    """The set of letters, 0 to 5, of each code point."""
    out = np.full(256, 5)
    for k, letters in enumerate(s for pair in SETS for s in pair):
        out[[ord(c) for c in letters]] = k
    return np.where(codes < 256, out[codes & 255], 5)


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks pairs of rows of code points (as long as each other, or b by one longer) that are one edit apart."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(1) == 1
    before, after = a != b[:, :n], (a != b[:, 1:])[:, ::-1]
    return np.where(before.any(1), before.argmax(1), n) + np.where(after.any(1), after.argmax(1), n) >= n


def near_in_tile(words: list[str], n: np.ndarray, role: np.ndarray) -> dict[str, list]:
    """Of two blocks (role 0 and 1; 2: one block with itself): each word that has a near one, how many, and the best of them."""
    order = np.argsort(role, kind="stable")
    words, n, role = [words[i] for i in order], n[order], role[order]
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    letters, column = np.unique(codes & 255, return_inverse=True)
    counts = np.bincount(row * len(letters) + column, minlength=len(words) * len(letters)).reshape(len(words), -1)
    fine = np.bincount(row * 6 + _fine(codes), minlength=len(words) * 6).reshape(-1, 6)
    exact = np.float32 if size.max() < 2000 else np.float64
    norms = (counts * counts).sum(1, keepdims=True) / -2
    # rows of which the product is minus half the squared distance
    left, right = (np.hstack(x).astype(exact) for x in ((counts, norms, np.ones_like(norms)), (counts, np.ones_like(norms), norms)))

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ordered by fine key, the keys, and where each begins."""
        keys, of = np.unique(fine[rows], axis=0, return_inverse=True)
        of = of.ravel()
        return rows[np.argsort(of, kind="stable")], keys, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(keys)))])

    alone = role[0] == 2
    mine = grouped(np.flatnonzero(role != 1))
    others = mine if alone else grouped(np.flatnonzero(role == 1))
    place = np.empty(len(words), np.int64)
    place[mine[0]] = np.arange(len(mine[0]))
    found_a, found_b = [], []
    for i, key in enumerate(mine[1]):
        moved = others[1] - key
        close = np.flatnonzero((np.maximum(moved, 0).sum(1) <= 1) & (np.minimum(moved, 0).sum(1) >= -1))
        if alone:
            close = close[close >= i]
        if not len(close):
            continue
        b = np.concatenate([others[0][others[2][j] : others[2][j + 1]] for j in close])
        mine_here = mine[0][mine[2][i] : mine[2][i + 1]]
        for at in range(0, len(mine_here), step := max(1, ENTRIES // len(b))):
            a = mine_here[at : at + step]
            hit = np.flatnonzero((left[a] @ right[b].T).ravel() >= -1)
            x, y = a[hit // len(b)], b[hit % len(b)]
            if alone:
                x, y = x[(keep := place[x] < place[y])], y[keep]
            found_a.append(x)
            found_b.append(y)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    true = np.zeros(len(a), bool)
    if len(a):
        m, k = size[a[0]], size[b[0]]  # all pairs of a tile have the same lengths
        for at in range(0, len(a), step := max(1, ENTRIES // int(k))):
            part = slice(at, at + step)
            true[part] = _edits(codes[starts[a[part], None] + np.arange(m)], codes[starts[b[part], None] + np.arange(k)])
    a, b = a[true], b[true]
    ranked = np.array(sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i])))
    rank = np.empty(len(words), np.int64)
    rank[ranked] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, rank[b])
    np.minimum.at(best, b, rank[a])
    n_near = np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
    has = np.flatnonzero(n_near)
    top = ranked[best[has]] if len(has) else has
    return {"word": [words[i] for i in has], "n_near": n_near[has].tolist(), "best_n": n[top].tolist(), "best": [words[i] for i in top]}


NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of distinct ``words`` (word, n): how many are one edit away, and the one of largest n."""
    joined = ["".join(pair) for pair in SETS[:2]]
    rest = [F.length("word") - F.length(F.translate("word", s, "")) for s in joined]
    placed = words.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(rest)]).withColumn("c2", F.length("word") - F.col("c0") - F.col("c1"))
    block = ["c0", "c1", "c2"]
    blocks = stored(placed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / block_words).cast("int").alias("chunks")))
    rows = placed.join(blocks, block).withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks").cast("int")).drop("chunks")

    # a block with itself and those that come after it, so that each pair is one tile
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0) and [a, b, c].count(1) <= 1 and [a, b, c].count(-1) <= 1]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in steps]))
    after = blocks.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(block)], F.col("chunks").alias("more"))
    pairs = blocks.withColumn("s", step).select(*block, "chunks", *[(F.col(f"c{i}") + F.col(f"s.d{i}")).alias(f"b{i}") for i in range(3)]).join(after, ["b0", "b1", "b2"])
    own = (F.col("b0") == F.col("c0")) & (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    tiles = pairs.withColumn("own", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("own"), F.col("i")).otherwise(0), F.col("more") - 1)))
    tiles = tiles.withColumn("tile", F.concat_ws(",", *block, "i", "b0", "b1", "b2", "j"))
    alone = F.col("own") & (F.col("i") == F.col("j"))
    side = lambda cols, chunk, role: F.struct(*[F.col(c).alias(x) for c, x in zip(cols, block, strict=True)], F.col(chunk).alias("chunk"), role.cast("int").alias("role"))
    first, second = side(block, "i", F.when(alone, 2).otherwise(0)), side(["b0", "b1", "b2"], "j", F.lit(1))
    sides = tiles.select("tile", F.explode(F.when(alone, F.array(first)).otherwise(F.array(first, second))).alias("s")).select("tile", "s.*")

    def run(table: pa.Table) -> pa.Table:
        found = near_in_tile(table["word"].to_pylist(), table["n"].to_numpy(), table["role"].to_numpy())
        return pa.table(found, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))

    each = rows.join(sides, [*block, "chunk"]).select("tile", "role", "word", "n").groupBy("tile").applyInArrow(run, NEAR)
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    words = stored(words_of(docs, doc_id, text))
    is_form = F.col("best_n") >= TIMES * F.col("n")
    found = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = stored(found)
    # Each form is ten times as frequent as its variant, so a path has at most as many steps as a count has digits; each round doubles the steps.
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = stored(up)
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = up.join(next_, "root", "left")
        if moved.where("__next is not null").isEmpty():
            break
        up = moved.select("word", F.coalesce("__next", "root").alias("root"))
    return found.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
