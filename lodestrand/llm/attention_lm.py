"""LM scoring: a small causal self-attention model on subword ids, trained and run in numpy inside Spark tasks.

Words (A-Z lower-cased) are cut greedily into the longest entries of a public subword vocabulary, word-initial
ones first; one end id closes each text.  Texts are cut once and their ids are stored.  The model factors a subword's
probability in two: its class, and itself within its class.

 - Class: softmax(attention + skip).  One head of causal attention over the window, with learnt vectors of subwords and
   places and a learnt bias for each distance, gives log odds of the classes; they are added to ``skip``, the logarithms of
   how often each class follows the subword before, counted over all training texts.  The HEAD most frequent subwords are
   classes of their own, so attention decides between them itself.
 - Within the class: how often the subword follows the one before, discounted, and the rest by its share of the class.

Texts are scored in overlapping windows of SPAN ids that begin STRIDE ids apart: the first window of a text
scores all its ids, later ones those that no window before has scored, so each is scored once, with at least
SPAN - STRIDE ids before it.  Windows of many texts form one batch of masked matrix products.

Training: each task takes gradient steps (Adam) from the current weights over its share of windows of its own
training texts; weights are averaged over tasks by numbers of windows, in ROUNDS rounds.  Counts of words,
subwords and pairs of subwords cover all training texts, and so do gradient steps: training windows follow each other
without a gap, round r takes those with index = r modulo ROUNDS, so each id is learnt once as a target.

The base score is a unigram one with add-one smoothing over words.  Counts of the most frequent words (at most
MOST_SENT of them) go along with the scoring tasks; all other words of each text join the table of counts.  So do pairs
of subwords: the most frequent (at most MOST_PAIRS) go along, each text's others are named and join the table of pairs, and
what a pair's count adds to the text's score comes from there.  The bounds decide the way, not the result.

Defined results: a null or empty text is its end alone; a null id counts as empty text for the fold; very long texts are
cut into as many windows as they need; equal rows get equal scores (to 32-bit rounding); without training texts all counts are 0 and classes are
even; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.blocks import BASE, CODES_LOWER, Block, _powers, blocks, mix
from lodestrand.llm.common import id_remainder, stored, text_batches

#: Subwords that are classes of their own, and further classes for the rest, half of them for subwords that begin words.
HEAD, REST = 44, 20
CLASSES = HEAD + REST
#: Rows of input vectors (what is rarer than the first of them shares them by hash), width of the model.
INPUTS, WIDTH = 4096, 16
SPAN, STRIDE = 32, 24
ROUNDS, RATE, BATCH = 2, 0.004, 48
#: Windows scored at once.
SCORED = 96
#: Longest vocabulary entry used, in bytes.
LONGEST = 16
#: Most words whose counts are sent along with tasks (16 bytes each), and most pairs (12 bytes each).
MOST_SENT, MOST_PAIRS = 1 << 17, 1 << 20
#: Taken off the count of each pair, for what wasn't seen; observations that the overall shares of classes count for.
DISCOUNT, PRIOR = 0.75, 4.0
#: Bytes of text cut at once; words whose cuts a worker remembers.
BLOCK, MEMORY = 1 << 21, 600_000
SEED = 7
_END_WORD = np.uint64(0x5BD1E9955BD1E995)
_SLOT_BITS, _KNOWN_BITS = 20, 21
_BEGINS = np.uint32(1 << 31)
#: Parts that counts are added up in.
PARTS = 128


class Subwords:
    """Greedy longest match against a vocabulary of byte strings; entries that begin with a space begin words."""

    def __init__(self, tokens: dict[bytes, int]):
        self.size = max(tokens.values(), default=-1) + 2
        self.end = self.size - 1
        self.forget()
        self.hashes, self.ids = np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, -1, np.int32)
        self.more, self.more_ids = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.first = np.zeros(self.size, bool)  # ids that begin a word, or end a text
        self.first[[i for token, i in tokens.items() if token.startswith(b" ") and len(token) > 1] + [self.end]] = True
        used = {}
        for token, i in sorted(tokens.items(), key=lambda x: x[1]):
            first = token.startswith(b" ")
            plain = token[1:] if first else token
            if 1 < len(plain) <= LONGEST or first and plain and len(plain) <= LONGEST:
                if plain == plain.lower() and not any(c in b" \t\n\r\x0b\x0c" for c in plain):
                    used[(plain, first)] = i
        names = list(used)
        if names:
            hashed = np.array([_hash(p, first) for p, first in names], np.uint64)
            slots = (hashed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            keep, at = np.unique(slots, return_index=True)
            values = np.array([used[n] for n in names], np.int32)
            self.hashes[keep], self.ids[keep] = hashed[at], values[at]
            over = np.setdiff1d(np.arange(len(names)), at)  # entries whose slot another has
            self.shared = np.zeros(1 << _SLOT_BITS, bool)
            self.shared[slots[over]] = True
            order = over[np.argsort(hashed[over])]
            self.more, self.more_ids = hashed[order], values[order]

    @classmethod
    def read(cls, data: bytes) -> Subwords:
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t})

    def forget(self) -> None:
        self.known, self.known_begin, self.known_count, self.known_ids = Pile(np.uint64), Pile(np.int64), Pile(np.int64), Pile(np.int32)
        self.keys = Pile(np.uint64)  # what ``spelled`` has of each word met
        self.known_at = np.full(1 << _KNOWN_BITS, -1, np.int32)
        self.over, self.over_at = np.empty(0, np.uint64), np.empty(0, np.int32)  # words whose slot another has

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word among those met before; negative: not met."""
        spot = self.known_at[(words >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)]
        if self.known.n:
            lost = np.flatnonzero(self.known.all[spot] != words)
            spot[lost] = -1
            if len(self.over):
                at = np.minimum(np.searchsorted(self.over, words[lost]), len(self.over) - 1)
                spot[lost] = np.where(self.over[at] == words[lost], self.over_at[at], -1)
        return spot

    def learn(self, words: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Remember how words that weren't met before are cut."""
        number = np.arange(self.known.n, self.known.n + len(words), dtype=np.int32)
        slots = (words >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)
        free = np.flatnonzero(self.known_at[slots] < 0)
        self.known_at[slots[free]] = number[free]
        over = np.flatnonzero(self.known_at[slots] != number)
        order = np.argsort(both := np.concatenate([self.over, words[over]]), kind="stable")
        self.over, self.over_at = both[order], np.concatenate([self.over_at, number[over]])[order]
        for pile, more in ((self.known, words), (self.known_begin, begin + self.known_ids.n), (self.known_count, count), (self.known_ids, ids), (self.keys, spelled(ids, begin, count))):
            pile.add(more)

    def cut(self, block: Block) -> tuple[np.ndarray, ...]:
        """(ids of all texts one after another, each closed by an end; where each text's begin; hashes of words met; which of them each word is; where its ids begin)."""
        starts, ends = block.words
        sums, (_, inv) = block.sums(True), _powers(len(block.data) + 1)
        words = block.spans(starts, ends, True, sums)
        if self.known.n > MEMORY:
            self.forget()
        number = self.find(words)
        lost = np.flatnonzero(number < 0)
        new, where, back = np.unique(words[lost], return_index=True, return_inverse=True)
        number[lost] = self.known.n + back
        where = lost[where]
        # cut each distinct word that wasn't met before, one more subword in each turn
        n = len(where)
        at, stop, live = starts[where].copy(), ends[where], np.arange(n)
        found, owners = [], []
        first = True
        while len(live):
            p, e = at[live], stop[live]
            got, size = self.single[_lower(block.data[p])], np.ones(len(live), np.int64)
            open_ = np.arange(len(live))
            for k in range(LONGEST, 0, -1):
                if k == 1 and not first:
                    break
                fit = open_[p[open_] + k <= e[open_]]
                if not len(fit):
                    continue
                q = p[fit]
                h = _finish((sums[q + k] - sums[q]) * inv[q], k, first)
                slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
                hit = self.hashes[slot] == h
                one = self.ids[slot]
                if len(self.more) and (also := np.flatnonzero(self.shared[slot] & ~hit)).size:
                    spot = np.minimum(np.searchsorted(self.more, h[also]), len(self.more) - 1)
                    there = self.more[spot] == h[also]
                    hit[also[there]] = True
                    one[also[there]] = self.more_ids[spot[there]]
                done = fit[hit]
                got[done], size[done] = one[hit], k
                mark = np.zeros(len(live), bool)
                mark[done] = True
                open_ = open_[~mark[open_]]
            found.append(got)
            owners.append(live)
            at[live] += size
            live = live[at[live] < stop[live]]
            first = False
        flat, owner = (np.concatenate(found), np.concatenate(owners)) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
        order = np.argsort(owner, kind="stable")
        flat = flat[order]
        count = np.bincount(owner, minlength=n)
        self.learn(new, np.cumsum(count) - count, count, flat)
        # lay the words of the texts out again, with an end after each text
        sizes = self.known_count.all[number]
        sums_ = np.concatenate([[0], np.cumsum(sizes)])
        per_text = np.zeros(len(block) + 1, np.int64)
        per_text[1:] = sums_[block.word_offs[1:]] + np.arange(1, len(block) + 1)
        out, inside = np.full(per_text[-1], self.end, np.int32), np.ones(per_text[-1], bool)
        inside[per_text[1:] - 1] = False
        at = np.repeat(self.known_begin.all[number] - sums_[:-1], sizes)
        at += np.arange(len(at))
        out[inside] = self.known_ids.all[at]
        return out, per_text, self.known.all, number, sums_[:-1] + block.doc_of_word


def spelled(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each word's ids, which no other word has: so words are told apart where texts aren't at hand."""
    h = mix(ids[begin].astype(np.uint64))
    live, at = np.flatnonzero(count > 1), 1
    while len(live):
        h[live] = mix(h[live] * BASE + ids[begin[live] + at].astype(np.uint64))
        at += 1
        live = live[count[live] > at]
    return h


def words_of(marked: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hash of each word, number of words of each text) from ids of which those that begin words are marked."""
    ids, begins = (marked & ~_BEGINS).astype(np.int64), marked >= _BEGINS
    bound = begins.copy()
    bound[offs[1:] - 1] = True  # an end closes each text
    at = np.flatnonzero(bound)
    word = np.flatnonzero(begins[at])
    return ids, spelled(ids, at[word], at[word + 1] - at[word]) if len(word) else np.empty(0, np.uint64), np.diff(np.searchsorted(at[word], offs))


class Pile:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.held, self.n = np.empty(1 << 10, dtype), 0

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.all, np.empty(self.n + 2 * len(more), self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def _finish(h: np.ndarray, size: int, first: bool) -> np.ndarray:
    return mix(h + np.uint64(2 * size + first))


def _hash(plain: bytes, first: bool) -> np.uint64:
    data = np.frombuffer(plain, np.uint8)
    p, _ = _powers(len(data))
    return _finish(np.array([np.sum(CODES_LOWER[data] * p, dtype=np.uint64)]), len(data), first)[0]


@dataclass
class Counted:
    """What is counted over all training texts and then fixed; see the module's text for what each is for."""

    of: np.ndarray  # class of each id
    row: np.ndarray  # input row of each id; row 0 is the beginning of a text
    share: np.ndarray  # each id's share of its class
    skip: np.ndarray  # natural logarithms of the classes' shares after each row
    pairs: np.ndarray  # row * size + id of the most frequent pairs, ascending
    values: np.ndarray  # discounted share of each pair's id among those of its class after the row
    left: np.ndarray  # what all pairs, sent or not, leave of each class after each row
    follows: np.ndarray  # how often each class comes after each row
    whole: bool = True  # whether ``pairs`` are all there are

    @classmethod
    def of_ids(cls, counts: np.ndarray, first: np.ndarray) -> Counted:
        """Classes and rows from the counts of ids; nothing yet of pairs."""
        n = len(counts)
        ranked = np.argsort(-counts, kind="stable")
        of = np.zeros(n, np.int32)
        for flag in (False, True):  # the rest: classes of equal weight, in order of frequency
            rest = ranked[HEAD:][first[ranked[HEAD:]] == flag]
            weight = np.cumsum(counts[rest] + 1e-3)
            of[rest] = HEAD + flag + 2 * np.minimum((weight / weight[-1] * (REST // 2)).astype(int), REST // 2 - 1) if len(rest) else HEAD
        of[ranked[:HEAD]] = np.arange(min(HEAD, n))
        row = 1 + (mix(np.arange(n, dtype=np.uint64) + np.uint64(99)) % np.uint64(INPUTS - 1)).astype(np.int32)
        row[ranked[: INPUTS - 1]] = np.arange(min(INPUTS - 1, n)) + 1
        total, members = np.bincount(of, counts, CLASSES), np.bincount(of, minlength=CLASSES)
        share = (counts + 0.1) / (total + 0.1 * members)[of]
        skip = np.log((total + 1) / (total.sum() + CLASSES)).astype(np.float32)
        return cls(of, row.astype(np.int32), share, np.tile(skip, (INPUTS, 1)), np.empty(0, np.int64), np.empty(0, np.float32), np.ones((INPUTS, CLASSES), np.float32), np.zeros((INPUTS, CLASSES)))

    def with_pairs(self, follows: np.ndarray, pairs: np.ndarray, n: np.ndarray, distinct: np.ndarray, whole: bool) -> Counted:
        """follows, distinct: how often each class comes after each row, and with how many ids; pairs, n: row * size + id of those sent and how often."""
        even = np.exp(self.skip[0].astype(np.float64))
        skip = np.log((follows + PRIOR * even) / (follows.sum(1, keepdims=True) + PRIOR)).astype(np.float32)
        order = np.argsort(pairs)
        left = np.where(follows > 0, DISCOUNT * distinct / np.maximum(follows, 1), 1)
        made = Counted(self.of, self.row, self.share, skip, pairs[order], np.empty(0, np.float32), left.astype(np.float32), follows, whole)
        made.values = made.value_of(pairs[order], n[order]).astype(np.float32)
        return made

    def value_of(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (n - DISCOUNT) / self.follows[pairs // len(self.of), self.of[pairs % len(self.of)]]

    def gain(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the count of a pair adds to the log10 probability that ``within`` has without it."""
        row, ids = pairs // len(self.of), pairs % len(self.of)
        return np.log10(1 + self.value_of(pairs, n) / (self.left[row, self.of[ids]] * self.share[ids]))

    def within(self, rows: np.ndarray, ids: np.ndarray, spots: Spots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each id in its class, after each row; places whose pair wasn't sent, with their pairs).  spots: of ``pairs``."""
        kind = self.of[ids]
        out = np.ones(len(ids))
        at = np.flatnonzero(kind >= HEAD)
        rows, ids, kind = rows[at], ids[at], kind[at]
        out[at] = self.left[rows, kind] * self.share[ids]
        key = rows.astype(np.int64) * len(self.of) + ids
        spot = spots.of(key)
        there = spot >= 0
        out[at[there]] += self.values[spot[there]]
        return out, at[~there], key[~there]


class Spots:
    """Where keys stand in an ascending array of distinct ones: a table of slots, and a search for keys whose slot another has."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(63 - len(keys).bit_length())
        self.table = np.full(2 << len(keys).bit_length(), -1, np.int32)
        slots = self._slots(keys)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)
        over = np.flatnonzero(self.table[slots] != np.arange(len(keys)))
        self.over, self.over_keys = over, keys[over]
        self.shared = np.zeros(len(self.table), bool)
        self.shared[slots[over]] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(asked), -1, np.int32)
        slots = self._slots(asked)
        spot = self.table[slots]
        lost = np.flatnonzero(self.keys[spot] != asked)
        spot[lost] = -1
        if len(self.over) and len(also := lost[self.shared[slots[lost]]]):
            at = np.minimum(np.searchsorted(self.over_keys, asked[also]), len(self.over) - 1)
            hit = self.over_keys[at] == asked[also]
            spot[also[hit]] = self.over[at[hit]]
        return spot


SHAPES = {"rows": (INPUTS, WIDTH), "places": (SPAN, WIDTH), "far": (SPAN,), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}


def fresh() -> dict[str, np.ndarray]:
    """Weights before training: attention looks at near subwords and changes nothing yet."""
    rng = np.random.default_rng(SEED)
    scale = {"rows": 0.3, "places": 0.05, "out": 0.02}
    out = {k: rng.normal(0, scale.get(k, WIDTH**-0.5), s).astype(np.float32) for k, s in SHAPES.items()}
    out["far"][:] = -0.7 * np.abs(np.arange(SPAN) - 1)
    return out


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


_FAR = np.where(np.tril(np.ones((SPAN, SPAN), bool)), np.arange(SPAN)[:, None] - np.arange(SPAN), SPAN)  # distance of what is looked at; SPAN: stands after
_CELLS = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)


class Room:
    """Arrays that are filled again by each batch: fresh memory for them costs more than what is computed in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


def folded(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that follow each other, multiplied once for all places: q with k, v with o; and the bias of each pair of places."""
    kind = w["rows"].dtype
    return (w["q"] @ w["k"].T) * np.asarray(WIDTH**-0.5, kind), w["v"] @ w["o"], np.append(w["far"], np.asarray(-1e9, kind))[_FAR]


def by_few(x: np.ndarray, windows: int) -> np.ndarray:
    """Places in groups of four windows or fewer: products of small matrices need no packing, which takes longer than they do."""
    return x.reshape(windows // (few := math.gcd(windows, 4)), few * len(x) // max(1, windows), x.shape[1])


def forward(
    w: dict[str, np.ndarray], skip: np.ndarray, rows: np.ndarray, classes: np.ndarray, since: int = 0, room: Room | None = None, fold: tuple[np.ndarray, ...] | None = None
) -> tuple[np.ndarray, tuple]:
    """(natural logarithms of the odds of the classes named, windows x places from ``since`` on; what ``backward`` needs, until ``room`` is used again)."""
    n, kind, asked = len(rows), w["rows"].dtype, SPAN - since
    space = room or Room()
    new = lambda name, *shape: space(name, shape, kind)
    near, gather, bias = fold or folded(w)
    cube = np.take(w["rows"], rows.ravel(), axis=0, out=new("x", n * SPAN, WIDTH), mode="clip").reshape(n, SPAN, WIDTH)
    cube += w["places"]
    turned = new("turned", n, WIDTH, SPAN)
    turned[:] = cube.transpose(0, 2, 1)
    x = cube.reshape(-1, WIDTH)
    if since:  # what stands before is looked at, but nothing is asked of it
        x = new("asked", n * asked, WIDTH)
        x.reshape(n, asked, WIDTH)[:] = cube[:, since:]
        rows, classes = rows[:, since:], classes[:, since:]
    y = np.matmul(x, near, out=new("y", *x.shape)).reshape(n, asked, WIDTH)
    a = np.matmul(y, turned, out=new("a", n, asked, SPAN))
    a += bias[since:]
    if a.max(initial=0) > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    sums = a.reshape(-1, SPAN) @ np.ones(SPAN, kind)
    mixed = np.matmul(a, cube, out=new("mixed", n, asked, WIDTH)).reshape(-1, WIDTH)
    mixed /= sums[:, None]
    h = np.matmul(mixed, gather, out=new("h", *x.shape))
    h += x
    p = new("p", len(h), CLASSES)
    np.matmul(by_few(h, n), w["out"], out=by_few(p, n))
    p += np.take(skip, rows.ravel(), axis=0, out=space("skip", p.shape, skip.dtype), mode="clip")
    if p.max(initial=0) > 60:
        np.minimum(p, 60, out=p)
    at = np.arange(0, p.size, CLASSES) + classes.ravel()
    picked = p.ravel()[at]
    np.exp(p, out=p)
    total = p @ np.ones(CLASSES, kind)
    return (picked - np.log(total)).reshape(n, -1), (near, gather, cube, turned, y, a, sums, mixed, h, p, total, at)


def backward(w: dict[str, np.ndarray], rows: np.ndarray, state: tuple, classes: np.ndarray, valid: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of valid places; uses up ``state``."""
    near, gather, cube, turned, y, a, sums, mixed, h, p, total, picked = state
    n, kind, x = len(rows), cube.dtype, cube.reshape(-1, WIDTH)
    space = room or Room()
    new = lambda name, *shape: space(name, shape, kind)
    every = np.ones(n, kind)
    weight = valid.ravel() * np.asarray(1 / max(1, valid.sum()), kind)
    d = p
    d *= (weight / total)[:, None]
    d.ravel()[picked] -= weight
    d3 = d.reshape(n, SPAN, CLASSES)
    g = {"out": (every @ np.matmul(h.reshape(n, SPAN, WIDTH).transpose(0, 2, 1), d3, out=new("douts", n, WIDTH, CLASSES)).reshape(n, -1)).reshape(WIDTH, CLASSES)}
    dx = np.matmul(d3, np.ascontiguousarray(w["out"].T), out=new("dx", *cube.shape)).reshape(-1, WIDTH)
    dgather = mixed.T @ dx
    g["v"], g["o"] = dgather @ w["o"].T, w["v"].T @ dgather
    dm = np.matmul(dx, np.ascontiguousarray(gather.T), out=new("dm", *x.shape))
    dm /= sums[:, None]
    dot = np.multiply(dm, mixed, out=new("part", *x.shape)) @ np.ones(WIDTH, kind)  # what softmax takes off each place
    dm = dm.reshape(cube.shape)
    ds = np.matmul(dm, turned, out=new("ds", n, SPAN, SPAN))
    ds -= dot.reshape(n, SPAN, 1)
    ds *= a
    g["far"] = np.bincount(_FAR.ravel(), every @ ds.reshape(n, -1))[:SPAN].astype(kind)
    dy = np.matmul(ds, cube, out=new("dy", *cube.shape)).reshape(-1, WIDTH)
    dnear = x.T @ dy
    dnear *= np.asarray(WIDTH**-0.5, kind)
    g["q"], g["k"] = dnear @ w["k"], dnear.T @ w["q"]
    dx += np.matmul(dy, np.ascontiguousarray(near.T), out=new("part", *x.shape))
    seen = dx.reshape(cube.shape)
    seen += np.matmul(ds.transpose(0, 2, 1), y, out=new("part", *cube.shape))
    seen += np.matmul(a.transpose(0, 2, 1), dm, out=new("part", *cube.shape))
    g["places"] = (every @ dx.reshape(n, -1)).reshape(SPAN, WIDTH)
    met = np.zeros(INPUTS, bool)
    met[rows.ravel()] = True
    at = np.flatnonzero(met)
    which = np.empty(INPUTS, np.int64)
    which[at] = np.arange(len(at))
    cells = np.take(_CELLS, np.take(which, rows.ravel()), axis=0, out=space("cells", x.shape, _CELLS.dtype), mode="clip")
    g["rows"] = (at, np.bincount(cells.ravel(), dx.ravel(), len(at) * WIDTH).reshape(-1, WIDTH).astype(kind))
    return g


class Odds:
    """What ``forward`` gives, by weights that don't change."""

    def __init__(self, w: dict[str, np.ndarray], skip: np.ndarray):
        self.w, self.skip, self.fold, self.room = w, skip, folded(w), Room()

    def of(self, rows: np.ndarray, classes: np.ndarray, since: int = 0) -> np.ndarray:
        return forward(self.w, self.skip, rows, classes, since, self.room, self.fold)[0]


def window_starts(offs: np.ndarray, stride: int) -> tuple[np.ndarray, ...]:
    """(where each window begins among all ids; how many ids its text has from there on; its text; index in the text)."""
    n = np.diff(offs)
    many = 1 + np.maximum(0, -(-(n - SPAN) // stride))
    text = np.repeat(np.arange(len(n)), many)
    index = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = offs[text] + index * stride
    return start, offs[text + 1] - start, text, index


def cut_windows(offs: np.ndarray, stride: int) -> tuple[np.ndarray, ...]:
    """``window_starts`` place by place: (index of each place's target among all ids, clipped; which places exist; which are scored; text of each window; index in the text)."""
    start, left, text, index = window_starts(offs, stride)
    real = np.arange(SPAN) < left[:, None]
    new = real & ((index == 0)[:, None] | (np.arange(SPAN) >= SPAN - stride))
    return np.minimum(start[:, None] + np.arange(SPAN), offs[-1] - 1), real, new, text, index


def inputs(ids: np.ndarray, offs: np.ndarray, counted: Counted) -> tuple[np.ndarray, np.ndarray]:
    """(row of the id before each id, 0 at the beginning of a text; class of each id), followed by SPAN places that no text has."""
    before, of = np.zeros((2, len(ids) + SPAN), np.int64)
    before[1 : len(ids)] = counted.row[ids[:-1]]
    before[offs[:-1]] = 0
    of[: len(ids)] = counted.of[ids]
    return before, of


class Trainer:
    """Adam over batches of windows; of the input vectors, a step moves those that it met."""

    def __init__(self, weights: np.ndarray, skip: np.ndarray):
        self.skip = skip
        self.flat = [np.array(weights, np.float32), *np.zeros((2, len(weights)), np.float32)]  # weights, and means of gradients and of their squares
        self.w = unpack(self.flat[0])
        self.t = self.windows = 0
        self.room = Room()

    def step(self, rows: np.ndarray, classes: np.ndarray, valid: np.ndarray) -> None:
        g = backward(self.w, rows, forward(self.w, self.skip, rows, classes, room=self.room)[1], classes, valid, self.room)
        self.t += 1
        self.windows += len(rows)
        at, d = g.pop("rows")
        d = np.concatenate([d.ravel(), *(g[k].ravel() for k in SHAPES if k in g)])
        n, rest = len(at) * WIDTH, INPUTS * WIDTH
        met = [self.room(f"met{i}", d.shape, d.dtype) for i in range(len(self.flat))]
        for x, y in zip(self.flat, met, strict=True):
            np.take(x[:rest].reshape(INPUTS, WIDTH), at, axis=0, out=y[:n].reshape(-1, WIDTH), mode="clip")
            y[n:] = x[rest:]
        self.move(*met, d)
        for x, y in zip(self.flat, met, strict=True):
            x[:rest].reshape(INPUTS, WIDTH)[at] = y[:n].reshape(-1, WIDTH)
            x[rest:] = y[n:]

    def move(self, w: np.ndarray, m: np.ndarray, s: np.ndarray, d: np.ndarray) -> None:
        """One step by gradients, which are used up."""
        rate = RATE * min(1, self.t / 20)
        slow, fast = 1 - 0.9**self.t, 1 - 0.99**self.t
        part = np.subtract(d, m, out=self.room("part", d.shape, d.dtype))
        part *= np.float32(0.1)
        m += part
        d *= d
        d -= s
        d *= np.float32(0.01)
        s += d
        np.divide(s, np.float32(fast), out=d)
        np.sqrt(d, out=d)
        d += np.float32(1e-6)
        np.divide(m, d, out=d)
        d *= np.float32(rate / slow)
        w -= d


CUT = "held_out boolean, ids binary, kind int, part int, keys binary, counts binary"


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    """id, held_out, text -> id, held_out, packed ids, marked where words begin; and rows of counts: kind (0: word, 1: pair of ids), part, packed keys and counts."""
    cutter = _subwords(vocabulary)
    held: dict[int, list] = {0: [], 1: []}
    size = {0: 0, 1: 0}
    like = None

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in held[kind]])).astype(np.int64)

    def counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (mix(keys.astype(np.uint64)) % np.uint64(PARTS)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        parts = np.flatnonzero(np.bincount(part, minlength=PARTS))
        ends = np.searchsorted(part[order], parts, "right")
        blobs = [pa.array([x.tobytes() for x in np.split(v[order], ends[:-1])], pa.binary()) for v in (keys.astype(np.uint64), n.astype(np.int64))]
        none = [pa.nulls(len(parts), t) for t in (like, pa.bool_(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(parts), kind, np.int32)), pa.array(parts.astype(np.int32)), *blobs], names=names)

    names = ["id", *(c.split()[0] for c in CUT.split(", "))]
    for batch in batches:
        like = batch.column(0).type
        held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for block in blocks(batch.column(2), BLOCK):
            ids, offs, _, back, begins = cutter.cut(block)
            words, n = cutter.keys.all, len(block)
            marked = ids.astype("<u4")
            marked[begins] |= _BEGINS
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * offs).astype(np.int32)), pa.py_buffer(marked)])
            same = [batch.column(i).slice(block.first, n) for i in range(2)]
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*same, packed, *none], names=names)
            learn = ~held_out[block.first : block.first + n]
            if not learn.any():
                continue
            times = np.bincount(back[learn[block.doc_of_word]], minlength=len(words))
            before = np.full(len(ids), cutter.size, np.int64)
            before[1:] = ids[:-1]
            before[offs[:-1]] = cutter.size
            live = np.repeat(learn, np.diff(offs))
            pairs, many = np.unique(before[live] * (cutter.size + 1) + ids[live], return_counts=True)
            for kind, keys, c in ((0, words[times > 0], times[times > 0]), (0, np.array([_END_WORD]), np.array([learn.sum()])), (1, pairs.astype(np.uint64), many)):
                held[kind].append((keys, c))
                size[kind] += len(keys)
                if size[kind] > 2_000_000:
                    held[kind] = [merged(kind)]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > 1_000_000:
                        yield counted(kind, *held[kind][0])
                        held[kind], size[kind] = [], 0
    for kind in (0, 1):
        if held[kind]:
            yield counted(kind, *merged(kind))


def _added(rows: pa.Table) -> pa.Table:
    """A part of a kind's keys and counts, packed -> kind, key, n, each key once."""
    keys, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("keys", "counts"))
    keys, back = np.unique(keys, return_inverse=True)
    return pa.table({"kind": np.full(len(keys), rows.column("kind")[0].as_py(), np.int32), "key": keys, "n": np.bincount(back, n).astype(np.int64)})


@lru_cache(maxsize=2)
def _subwords(vocabulary: bytes) -> Subwords:
    """One for each worker, whatever the number of tasks."""
    return Subwords.read(vocabulary)


def _learn(batches: Iterator[pa.RecordBatch], counted: Counted, weights: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """ids -> place, value: a task's weights times its windows, and the number of windows at place -1."""
    trainer = Trainer(weights, counted.skip)
    for batch in batches:
        for block in blocks(batch.column(0), 4 * BLOCK):
            ids, offs = np.frombuffer(block.data.tobytes(), "<u4") & ~_BEGINS, block.offs // 4
            start, left, _, index = window_starts(offs, SPAN)
            mine = np.flatnonzero(index % ROUNDS == turn)
            mine = np.random.default_rng(SEED).permutation(mine)
            before, targets = (sliding_window_view(x, SPAN) for x in inputs(ids, offs, counted))
            for i in range(0, len(mine), BATCH):
                at = mine[i : i + BATCH]
                trainer.step(before[start[at]], targets[start[at]], np.arange(SPAN) < left[at][:, None])
    if trainer.windows:
        flat = pack(trainer.w).astype(np.float64) * trainer.windows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.concatenate([[float(trainer.windows)], flat]))], names=["place", "value"])


def log10_of(ids: np.ndarray, offs: np.ndarray, counted: Counted, odds: Odds, spots: Spots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability of each text of a block, given its ids and the pairs sent; text and pair of each place whose pair wasn't sent)."""
    start, left, text, index = window_starts(offs, STRIDE)
    before, targets = inputs(ids, offs, counted)
    inside, lost, pairs = counted.within(before[: len(ids)], ids, spots)
    if counted.whole:  # no text has pairs that are counted elsewhere
        lost, pairs = lost[:0], pairs[:0]
    total = np.add.reduceat(np.log10(inside), offs[:-1])
    before, targets = sliding_window_view(before, SPAN), sliding_window_view(targets, SPAN)
    by_window = np.zeros(len(start))
    for since in (0, SPAN - STRIDE):  # first windows of texts, and others
        which = np.flatnonzero((index == 0) == (since == 0))
        for i in range(0, len(which), SCORED):
            at = which[i : i + SCORED]
            logp = odds.of(before[start[at]], targets[start[at]], since)
            logp[np.arange(since, SPAN) >= left[at][:, None]] = 0
            by_window[at] = logp.sum(1, dtype=np.float64)
    total += np.bincount(text, by_window, len(offs) - 1) / np.log(10)
    return total, np.searchsorted(offs, lost, "right") - 1, pairs


def _listed_by_text(of: np.ndarray, keys: np.ndarray, n: int) -> list[pa.ListArray]:
    """Distinct keys of each of n texts, and how often each occurs."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(head)
    times = np.diff(np.append(at, len(keys))).astype(np.int32)
    bounds = np.searchsorted(of[at], np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (keys[at].view(np.int64), times)]


def _score(batches: Iterator[pa.RecordBatch], counted: Counted, weights: np.ndarray, sent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """id, held_out, ids -> id, held_out, n_tokens, score, known and base of words sent, other words and pairs and how often."""
    odds = Odds(unpack(weights), counted.skip)
    keys, counts = sent
    logs = np.log10(counts + 1.0)
    sent_words, sent_pairs = Spots(keys), Spots(counted.pairs)
    for batch in batches:
        for block in blocks(batch.column(2), BLOCK):
            n, offs = len(block), block.offs // 4
            ids, words, many = words_of(np.frombuffer(block.data.tobytes(), "<u4"), offs)
            doc = np.repeat(np.arange(n), many)
            total, text, pairs = log10_of(ids, offs, counted, odds, sent_pairs)
            # words: those whose counts were sent are added up here, the others are named
            spot = sent_words.of(words)
            there = spot >= 0
            known = np.bincount(doc[there], minlength=n)
            base = np.bincount(doc[there], logs[spot[there]], n)
            same = [batch.column(i).slice(block.first, n) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(many.astype(np.int64) + 1), pa.array(total), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), *_listed_by_text(doc[~there], words[~there], n), *_listed_by_text(text, pairs, n)],
                names=["id", "held_out", "n_tokens", "score", "known", "base", "rare", "times", "pairs", "pair_times"],
            )


def _gains(batches: Iterator[pa.RecordBatch], counted: Counted) -> Iterator[pa.RecordBatch]:
    """pair, n -> pair, what its count adds to a score."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted.gain(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["key", "gain"])


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``n`` is at least a power of two, such that ``most`` are at most; the others)."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    least, n = 64, 0
    for at, many in sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        n += many
        if n > most:
            break
        least = at
    return counts.where(level >= least), counts.where(level < least)


def count(counts: DataFrame, cutter: Subwords) -> tuple[Counted, DataFrame]:
    """Classes, rows and pairs from the counts of pairs (kind 1) over all training texts; (pair, n) of those that aren't sent along."""
    wide, most = cutter.size + 1, cutter.size
    pairs = counts.where("kind = 1").select(F.expr(f"key div {wide}").alias("before"), (F.col("key") % wide).alias("id"), "n")
    n = np.zeros(cutter.size)
    for row in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a line for each entry of the vocabulary
        n[row.id] = row.n
    made = Counted.of_ids(n, cutter.first)
    tables = pairs.sparkSession.sparkContext.broadcast((np.append(made.row, 0), made.of))  # two numbers for each entry

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, of = tables.value
        for batch in batches:
            ids = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row[batch.column(0).to_numpy()].astype(np.int64) * most + ids), pa.array(row[batch.column(0).to_numpy()].astype(np.int64) * CLASSES + of[ids]), batch.column(2)], names=["pair", "cell", "n"])

    cells = pairs.mapInArrow(mapped, "pair long, cell long, n long")
    by_pair = stored(cells.groupBy("pair", "cell").agg(F.sum("n").alias("n")))
    follows, distinct = np.zeros(INPUTS * CLASSES), np.zeros(INPUTS * CLASSES)
    for row in by_pair.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).toLocalIterator():  # INPUTS x CLASSES lines at most
        follows[row.cell], distinct[row.cell] = row.n, row.ids
    asked = by_pair.where(F.col("cell") % CLASSES >= HEAD).select("pair", "n")  # a class of its own has one id
    frequent, others = _frequent(asked, MOST_PAIRS)
    top = frequent.toArrow()  # MOST_PAIRS lines at most
    whole = top.num_rows == distinct.reshape(INPUTS, CLASSES)[:, HEAD:].sum()
    shape = (INPUTS, CLASSES)
    return made.with_pairs(follows.reshape(shape), top.column("pair").to_numpy(), top.column("n").to_numpy().astype(np.float64), distinct.reshape(shape), bool(whole)), others


def score(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(``doc_id``, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    vocabulary: file of a public byte-level vocabulary; held_out: crc32(id as text) modulo ``folds`` is ``held``.
    """
    spark = text_batches(docs)
    with open(vocabulary, "rb") as f:
        data = f.read()
    ranks = spark.sparkContext.broadcast(data)  # a vocabulary file, about 1 MB
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), (id_remainder(doc_id, folds) == held).alias("held_out"), F.col(f"`{text}`").alias("text"))
    cut = stored(src.mapInArrow(lambda b: _cut(b, ranks.value), f"id {dict(src.dtypes)['id']}, {CUT}"))
    texts = cut.where("kind is null")
    counts = stored(cut.where("kind is not null").select("kind", "part", "keys", "counts").groupBy("kind", "part").applyInArrow(_added, "kind int, key long, n long"))
    words = counts.where("kind = 0")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    made, other_pairs = count(counts, _subwords(data))
    counted = spark.sparkContext.broadcast(made)

    weights = pack(fresh())
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)
        learnt = texts.where("not held_out").select("ids").mapInArrow(lambda b, now=now, turn=turn: _learn(b, counted.value, now.value, turn), "place int, value double")
        added = learnt.groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # a line for each weight
        if len(added):
            by_place = added.column("value").to_numpy()[np.argsort(added.column("place").to_numpy())]
            weights = by_place[1:] / by_place[0]

    frequent, others = _frequent(words.select("key", "n"), MOST_SENT)
    top = frequent.toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], n[order]))
    model = spark.sparkContext.broadcast(weights)

    fields = "held_out boolean, n_tokens long, score double, known long, base double, rare array<long>, times array<int>, pairs array<long>, pair_times array<int>"
    scored = texts.select("id", "held_out", "ids").mapInArrow(lambda b: _score(b, counted.value, model.value, sent.value), f"id {dict(src.dtypes)['id']}, {fields}")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    named = lambda keys, times: scored.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))
    met = named("rare", "times").join(others, "key").select("row", "times", (F.col("times") * F.log10(F.col("n") + 1.0)).alias("base"), F.lit(0.0).alias("gain"))
    if not made.whole:
        gains = other_pairs.mapInArrow(lambda b: _gains(b, counted.value), "key long, gain double")
        met = met.union(named("pairs", "pair_times").join(gains, "key").select("row", F.lit(0), F.lit(0.0), F.col("times") * F.col("gain")))
    more = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum("base").alias("more_base"), F.sum("gain").alias("more_score"))
    end = words.where(F.col("key") == int(_END_WORD.view(np.int64))).select("n").first()
    end_n = end.n if end else 0
    out = scored.join(more, "row", "left")
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + int(end_n > 0)
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) + float(np.log10(end_n + 1.0)) - F.col("n_tokens") * float(np.log10(sums.n + sums.v + 1.0))
    return out.select(F.col("id").alias(doc_id), "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(sums.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
