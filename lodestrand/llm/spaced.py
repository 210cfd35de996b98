"""Texts as units that begin with a space, whose tokens don't depend on what stands around them.

Byte-level and piece vocabularies alike end a token before a single space that stands between two other signs: none of their tokens holds a space
after another sign.  So a text can be cut there, and each distinct unit needs to be encoded only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress

#: The space between two signs that aren't white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Signs of a text that are cut into units at once; units of a generation that are kept; longest unit that is kept.
SIGNS, MOST_KEPT, LONGEST_KEPT = 1 << 20, 300_000, 64


def _clean(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


def slices(text: str) -> Iterator[str]:
    """A text in slices of about ``SIGNS`` signs that begin with a space, but for the first."""
    at = 0
    while at < len(text):
        found = BETWEEN.search(text, at + SIGNS) if len(text) - at > SIGNS else None
        end = found.start() if found else len(text)
        yield text if end - at == len(text) else text[at:end]
        at = end


class Units:
    """Values of units, each computed once while it is kept.

    compute: values of a list of units, none of them None.
    """

    def __init__(self, compute: Callable[[list[str]], list], most: int = MOST_KEPT):
        self.compute, self.most = compute, most
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def of(self, text: str) -> Iterator[list]:
        """Values of the units of a space and a text, in order, a slice of the text at a time."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        for i, part in enumerate(slices(text)):
            yield self._values(part[1:] if i else part)

    def _values(self, text: str) -> list:
        parts = text.split(" ")
        values = list(map(self.known.get, parts))
        if None not in values:
            return values
        known = self.known
        new = dict.fromkeys(compress(parts, [v is None for v in values]))
        if not all(map(_clean, new)):
            parts = BETWEEN.split(text)
            new = dict.fromkeys(p for p in parts if p not in known)
        # what the generation before knew moves to this one; the rest of it goes when this one is full
        known.update((p, v) for p, v in zip(new, map(self.older.get, new), strict=True) if v is not None)
        lost = [p for p in new if p not in known]
        found = dict(zip(lost, self.compute([" " + p for p in lost]), strict=True))
        known.update((p, v) for p, v in found.items() if len(p) <= LONGEST_KEPT and _clean(p))
        return [found[p] if p in found else known[p] for p in parts]
