"""Byte-level BPE by corpus-level merge replay, and the way back.

Texts are cut into pieces by the vocabulary's pattern, and BPE never looks past a piece, so each distinct
piece of a block of texts is encoded once.  The distinct pieces lie in one flat array of symbols.  An
inverted index leads from a pair of neighbouring tokens (named by the id that it merges to) to the
positions where the pair stands; merges are replayed over all pieces at once in rank order, and each merge
touches just the two pairs beside it: many places of a rank at once by numpy, few one by one.

No Python object is made per piece: classes of characters give the cuts, pieces are named by 64-bit hashes, and each
occurrence is compared byte by byte with the piece whose ids it gets.  Spark deals out the texts; nothing is
shuffled; a Python worker keeps its vocabulary, and a task a bounded memory of the pieces that it met most often.

Ids are packed as little-endian unsigned 32-bit integers in a binary column, which costs 4 bytes a token;
``unpack`` gives an array column.

Defined results: a null or empty text has no ids and decodes to no bytes; very long texts are blocks of their own;
nulls elsewhere are carried; repeated rows are encoded one by one; an empty table gives an empty result; input
columns named like a result are left out.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.blocks import Block, blocks
from lodestrand.llm.common import text_batches

#: Pieces that a task remembers; past that it forgets those met least.
CACHE_PIECES = 400_000
#: Bytes of text encoded at once, and ids decoded at once.
BLOCK_BYTES, BLOCK_IDS = 1 << 20, 1 << 17
#: A vocabulary file larger than this isn't sent to the workers.
MOST_VOCABULARY_BYTES = 32 << 20
#: Fixed value: the pattern whose cuts ``cut`` makes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places of a rank from which numpy merges them together.
MANY = 40

#: Code points that only the newest Unicode versions call letters or numbers.  The library whose ids
#: are to be matched doesn't know them yet and takes them for other symbols.
UNKNOWN_SIGNS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Ranks of byte strings, and which two tokens merge into which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.made = np.array([self.merges[p] for p in self.pairs.tolist()], np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs merge into; -1 where nothing, or where a side is negative."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)


@lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    """One for each worker, whatever the number of tasks."""
    return Vocabulary.read(data)


@lru_cache(maxsize=2)
def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes one after another, where each id's begin; one more entry than ids)."""
    tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines()) if token}
    listed = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
    return np.frombuffer(b"".join(listed), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in listed], dtype=np.int64)])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


class _Replay:
    """Symbols of all pieces, neighbours, and the index from a pair's rank to its places."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, voc: Vocabulary):
        n, sizes = len(offs) - 1, np.diff(offs)
        self.voc, self.starts = voc, offs[:-1] + np.arange(n)  # a separator follows each piece
        total = int(offs[-1]) + n
        self.symbols = np.full(total + 1, -1, np.int32)
        inside = ragged(self.starts, sizes)
        self.symbols[inside] = voc.byte_ids[data[: len(inside)]]
        self.after, self.before = np.arange(1, total + 2, dtype=np.int32), np.arange(-1, total, dtype=np.int32)
        self.pair = np.full(total + 1, -1, np.int32)  # the rank of the pair that begins here
        self.pair[:-1] = voc.rank(self.symbols[:-1], self.symbols[1:])
        at = np.flatnonzero(self.pair >= 0)
        self.index: dict[int, list] = {}
        self.queue: list[int] = []
        self._enter(at, self.pair[at])

    def _enter(self, places: np.ndarray, ranks: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            self._add(rank, places[a:b])

    def _add(self, rank: int, some) -> None:
        if rank in self.index:
            self.index[rank].append(some)
        else:
            self.index[rank] = [some]
            heapq.heappush(self.queue, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each piece has)."""
        while self.queue:
            rank = heapq.heappop(self.queue)
            parts = self.index.pop(rank, None)
            if parts is None:
                continue
            arrays = [p for p in parts if isinstance(p, np.ndarray)]
            singles = [p for p in parts if not isinstance(p, np.ndarray)]
            if sum(map(len, arrays)) + len(singles) < MANY:
                self._few(rank, sorted({*singles, *(x for a in arrays for x in a.tolist())}))
            else:
                self._many(rank, _distinct(np.concatenate([*arrays, np.array(singles, np.int64)])))
        live = self.symbols >= 0
        sums = np.concatenate([[0], np.cumsum(live)])
        bounds = np.append(self.starts, len(live))
        return self.symbols[live], np.diff(sums[bounds])

    def _few(self, rank: int, places: list[int]) -> None:
        symbols, after, before, pair, merges = (memoryview(self.symbols), memoryview(self.after), memoryview(self.before), memoryview(self.pair), self.voc.merges.get)
        for k, i in enumerate(places):
            if pair[i] != rank:
                continue  # a neighbour has merged meanwhile
            j = after[i]
            right, prior = after[j], before[i]
            symbols[i], symbols[j], pair[j] = rank, -2, -1
            after[i], before[right] = right, i
            lower = False
            made = merges(rank << 32 | symbols[right], -1) if symbols[right] >= 0 else -1
            pair[i] = made
            if made >= 0:
                self._add(made, i)
                lower = made < rank
            if prior >= 0 and symbols[prior] >= 0:
                made = merges(symbols[prior] << 32 | rank, -1)
                pair[prior] = made
                if made >= 0:
                    self._add(made, prior)
                    lower |= made < rank
            if lower:  # that pair goes first; the places left over wait
                for place in places[k + 1 :]:
                    self._add(rank, place)
                break

    def _many(self, rank: int, places: np.ndarray) -> None:
        symbols, after, before, pair = self.symbols, self.after, self.before, self.pair
        places = places[pair[places] == rank]
        if not len(places):
            return
        # of pairs that overlap in a row, every other one merges, from the left
        linked = np.zeros(len(places), bool)
        linked[1:] = after[places[:-1]] == places[1:]
        count, every = np.arange(len(places)), places
        places = places[(count - np.maximum.accumulate(np.where(linked, 0, count))) % 2 == 0]
        # pieces in which a merge makes a pair of lower rank go on with that; just their first merge is made now
        right = after[after[places]]
        one = np.full(len(places), rank, np.int32)
        made = self.voc.rank(one, symbols[right])
        prior = np.maximum(before[places], 0)
        merged_left = np.zeros(len(places), bool)
        merged_left[1:] = right[:-1] == places[1:]
        other = self.voc.rank(np.where(before[places] >= 0, np.where(merged_left, rank, symbols[prior]), -1).astype(np.int32), one)
        low = ((made >= 0) & (made < rank)) | ((other >= 0) & (other < rank))
        if low.any():
            piece = np.searchsorted(self.starts, places, "right")
            held = np.isin(piece, piece[low])
            held[np.unique(piece, return_index=True)[1]] = False
            waiting = every[np.isin(np.searchsorted(self.starts, every, "right"), piece[low])]
            self._add(rank, waiting[~np.isin(waiting, places[~held])])
            places = places[~held]
        j = after[places]
        right, prior = after[j], before[places]
        symbols[places], symbols[j], pair[j] = rank, -2, -1
        after[places] = right
        before[right] = places
        # neighbours as they are after all merges; a merged pair's left neighbour may itself have merged
        right, prior = after[places], before[places]
        prior = prior[prior >= 0]
        pair[places] = self.voc.rank(symbols[places], symbols[right])
        pair[prior] = np.where(symbols[prior] >= 0, self.voc.rank(symbols[prior], symbols[after[prior]]), -1)
        touched = np.concatenate([places, prior])  # a place entered twice is met once
        touched = touched[pair[touched] >= 0]
        self._enter(touched, pair[touched])


def replay(data: np.ndarray, offs: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces that lie one after another in ``data`` from ``offs`` on (none empty), and how many each has."""
    return _Replay(data, offs, voc).run()


LETTER, NUMBER, SPACES, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the pattern tells them apart."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    kinds = [(kind, regex.compile(pattern)) for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACES, r"\s+"), (OTHER, f"[{UNKNOWN_SIGNS}]+"))]
    for low in range(0, 0x110000, 0x800):
        if 0xD800 <= low < 0xE000:
            continue  # surrogates are no characters
        some = "".join(map(chr, range(low, low + 0x800)))
        for kind, pattern in kinds:
            for m in pattern.finditer(some):
                out[low + m.start() : low + m.end()] = kind
    return out


def cut(block: Block) -> np.ndarray:
    """Byte positions where the pattern's pieces begin in a block of texts, ascending, and the end."""
    data = block.data
    if not len(data):
        return np.zeros(1, np.int64)
    table = classes()
    if data.max() < 128:
        chars, kind = None, table[data]
        codes, ends = data, block.offs
    else:
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = table[codes]
        ends = np.searchsorted(chars, block.offs)
    n = len(kind)
    edge = np.zeros(n + 1, bool)  # where a text begins or ends
    edge[ends] = True
    begin = edge.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    space, blank = kind == SPACES, codes == 32
    follows = np.zeros(n, bool)  # a character of the same text follows that is no white space
    follows[:-1] = ~space[1:] & ~edge[1:n]
    last = space & follows
    begin[:n] |= last  # a row of white space leaves its last one to what follows
    taken = last & blank
    begin[1:n] &= ~taken[:-1] | edge[1:n]  # a blank goes with what follows it
    # contractions: an apostrophe that begins a piece, and letters right behind it
    mark = np.flatnonzero((codes == 39) & begin[:n])
    mark = mark[(mark + 1 < n)]
    if len(mark):
        mark = mark[~edge[mark + 1]]
        one = codes[mark + 1]
        two = np.where((mark + 2 < n) & ~edge[np.minimum(mark + 2, n)], codes[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[mark[short | long] + 1] = False
        begin[mark[short] + 2] = True
        begin[mark[long] + 3] = True
    begin[n] = True
    at = np.flatnonzero(begin)
    return at if chars is None else np.append(chars, len(data))[at]


class Encoder:
    """Encodes blocks of texts; ids of pieces met before are looked up by hash."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.hashes, self.met = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.data, self.offs = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_offs = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, block: Block, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Replay merges over new pieces and enter them."""
        if len(self.hashes) + len(hashes) > CACHE_PIECES and len(self.hashes):
            self._keep(np.sort(np.argsort(-self.met, kind="stable")[: max(0, CACHE_PIECES // 2)]))
        offs = np.concatenate([[0], np.cumsum(sizes)])
        data = block.data[ragged(starts, sizes)]
        ids, many = replay(data, offs, self.voc)
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])
        self.met = np.concatenate([self.met, np.zeros(len(hashes), np.int64)])
        self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        self.id_offs = np.concatenate([self.id_offs, self.id_offs[-1] + np.cumsum(many)])
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])
        self._keep(order)

    def _keep(self, which: np.ndarray) -> None:
        for values, offs in (("data", "offs"), ("ids", "id_offs")):
            where, sizes = getattr(self, offs)[which], np.diff(getattr(self, offs))[which]
            setattr(self, values, getattr(self, values)[ragged(where, sizes)])
            setattr(self, offs, np.concatenate([[0], np.cumsum(sizes)]))
        self.hashes, self.met = self.hashes[which], self.met[which]

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin; one more entry than texts)."""
        cuts = cut(block)
        starts, sizes = cuts[:-1], np.diff(cuts)
        own, first, back, times = np.unique(block.spans(starts, cuts[1:]), return_index=True, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.hashes, own), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != own if len(self.hashes) else np.ones(len(own), bool)
        if new.any():
            self._learn(block, own[new], starts[first[new]], sizes[first[new]])
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            if (lost := self.hashes[at] != own).any():  # forgotten while others were learnt
                self._learn(block, own[lost], starts[first[lost]], sizes[first[lost]])
                at = np.searchsorted(self.hashes, own)
        self.met[at] += times
        spot = at[back]
        if not np.array_equal(np.diff(self.offs)[spot], sizes) or not np.array_equal(self.data[ragged(self.offs[spot], sizes)], block.data):
            return self._apart(block, cuts)  # two pieces have the same hash
        many = np.diff(self.id_offs)[spot]
        ids = self.ids[ragged(self.id_offs[spot], many)]
        sums = np.concatenate([[0], np.cumsum(many)])
        return ids, sums[np.searchsorted(cuts, block.offs)]


    def _apart(self, block: Block, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with pieces told apart by their bytes and nothing remembered."""
        text = block.data.tobytes()
        pieces = [text[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        ids, many = replay(np.frombuffer(b"".join(place), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in place])]), self.voc)
        spot = np.array([place[p] for p in pieces])
        sums = np.concatenate([[0], np.cumsum(many[spot])])
        return ids[ragged((np.cumsum(many) - many)[spot], many[spot])], sums[np.searchsorted(cuts, block.offs)]


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary column, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MOST_VOCABULARY_BYTES} bytes")
    return data


def _appended(df: DataFrame, source: str, name: str, keep: list[str] | None, make) -> DataFrame:
    """Add the binary column ``name``, which ``make()(values) -> iterator of arrays`` gives for ``source``, one made for each task."""
    text_batches(df)
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    src = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{source}`").alias("__in"))
    schema = T.StructType([f for f in src.schema if f.name != "__in"] + [T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            first = 0
            for made in work(batch.column(len(carried))):
                cols = [batch.column(i).slice(first, len(made)) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*cols, made], names=schema.names)
                first += len(made)

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str = PATTERN, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``, the packed ids of every whole text, by the ranks in the file ``vocabulary`` on the driver.

    pattern: has to be ``PATTERN``, whose cuts are the only ones made; keep: columns to carry along (all by default).
    """
    if pattern != PATTERN:
        raise ValueError("only the pattern of bpe_replay.PATTERN is known")
    data = df.sparkSession.sparkContext.broadcast(_vocabulary_bytes(vocabulary))

    def make():
        coder = Encoder(_vocabulary(data.value))

        def work(column: pa.Array) -> Iterator[pa.Array]:
            for block in blocks(column, BLOCK_BYTES):
                found, offs = coder(block)
                yield _binary(found.astype("<u4").view(np.uint8), 4 * offs)

        return work

    return _appended(df, text, ids, keep, make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the bytes that packed ids stand for (cast to string where they are whole texts)."""
    data = df.sparkSession.sparkContext.broadcast(_vocabulary_bytes(vocabulary))

    def work(column: pa.Array) -> Iterator[pa.Array]:
        tokens, where = _tokens(data.value)
        sizes = np.diff(where)
        for block in blocks(column, 4 * BLOCK_IDS):
            found = np.frombuffer(block.data.tobytes(), "<u4").astype(np.int64)
            many = sizes[found]
            sums = np.concatenate([[0], np.cumsum(many)])
            yield _binary(tokens[ragged(where[found], many)], sums[block.offs // 4])

    return _appended(df, ids, out, keep, lambda: work)


def n_tokens(ids: Column) -> Column:
    """How many ids a packed column has."""
    return (F.octet_length(ids) / 4).cast("long")


def unpack(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    pair = lambda x, k: F.substring(x, 2 * k + 1, 2)
    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit(".{8}"), F.lit(0)), lambda x: F.conv(F.concat(pair(x, 3), pair(x, 2), pair(x, 1), pair(x, 0)), 16, 10).cast("long"))
