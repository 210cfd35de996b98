"""Vectorised word streams.

Arrow hands a column of texts over as one byte buffer with offsets.  Everything here works on that
buffer with numpy, a bounded block of whole documents at a time, so no Python object is made per word.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 sequence, so this equals the pattern on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]
_POWERS: list[np.ndarray] = []

#: Spans are hashed by a polynomial modulo 2**64 and by one modulo a prime: of the first alone, a Thue-Morse word and its complement collide for any base.
PRIME, PRIME_BASE = np.uint64((1 << 31) - 1), 1_103_515_245
_PRIME_POWERS: list[np.ndarray] = []


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    for _ in range(2):
        x = (x & PRIME) + (x >> np.uint64(31))
    return x - PRIME * (x >= PRIME)


PRIME_CODES = _modulo(CODES >> np.uint64(2))
PRIME_CODES_LOWER = PRIME_CODES.copy()
PRIME_CODES_LOWER[65:91] = PRIME_CODES[97:123]


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _PRIME_POWERS or len(_PRIME_POWERS[0]) < n:
        size = max(n + (n >> 3), BLOCK_BYTES + (1 << 17))
        out = []
        for base in (PRIME_BASE, pow(PRIME_BASE, -1, int(PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, _modulo(p * np.uint64(pow(base, len(p), int(PRIME))))])
            out.append(p[:size])
        _PRIME_POWERS[:] = out
    return _PRIME_POWERS[0][:n], _PRIME_POWERS[1][:n]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n + (n >> 3), BLOCK_BYTES + (1 << 17))  # with room for somewhat larger blocks
        out = []
        for base in (BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Block:
    """Whole documents: ``data`` bytes, ``offs`` where each begins (one more entry than documents)."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words begin and end."""
        inside = ~SPACE[self.data]
        n = len(inside)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:n]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @cached_property
    def word_offs(self) -> np.ndarray:
        """Where each document's words begin in the word stream."""
        return np.searchsorted(self.words[0], self.offs)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offs)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def sums(self, lower: bool) -> np.ndarray:
        p, _ = _powers(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((CODES_LOWER if lower else CODES)[self.data] * p, out=out[1:])
        return out

    def prime_sums(self, lower: bool) -> np.ndarray:
        x = (PRIME_CODES_LOWER if lower else PRIME_CODES)[self.data]
        x *= _prime_powers(len(x))[0]
        high = x >> np.uint64(31)
        x &= PRIME
        x += high
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=out[1:])
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, sums: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes wherever they stand.  sums: ``self.sums(lower)`` where that is known."""
        sums, (_, inv) = self.sums(lower) if sums is None else sums, _powers(len(self.data) + 1)
        first = (sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64)
        sums, (_, inv) = self.prime_sums(lower), _prime_powers(len(self.data) + 1)
        return mix(mix(first) + _modulo(_modulo(sums[ends] - sums[starts]) * inv[starts]))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """One hash for each word; A-Z count as a-z if ``lower``."""
        return self.spans(*self.words, lower=lower)

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each document has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offs])

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text or binary column into blocks of at most ``most`` bytes, or of one longer document.  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield Block(i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` successive items of a stream (runs over document ends included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= BASE
        out += hashes[k : k + n]
    return mix(out)


def window_heads(block: Block, size: int) -> np.ndarray:
    """Marks word positions from which ``size`` words of the same document follow."""
    ends = np.repeat(block.word_offs[1:], block.n_words)
    return np.arange(len(ends)) + size <= ends
