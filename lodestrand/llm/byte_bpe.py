"""Ids of the ``tokenizers`` library by a byte-level vocabulary file, from a faster library wherever the two can't differ.

They split texts alike where both know all letters and digits, which is tested for signs below U+0250, and merge alike if the ids of merged
tokens rise in the order of merges.  Other texts, and files of another kind, are left to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers

#: Signs that a text may hold for the faster way.
OTHER = re.compile("[^\x00-ɏ]")


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Tokens with their ids, or None if the file asks for more than splitting by the common pattern and merging by rank."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and found.get("normalizer") is None
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {t["content"] for t in found.get("added_tokens", ())}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if order != sorted(set(order)) or set(model["vocab"]) - set(merges) - special - set(letters()):
        return None
    byte = letters()
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function that gives the ids of a text; names of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    ranks = _ranks(path)
    if ranks is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow.encode(text, add_special_tokens=False).ids if OTHER.search(text) else fast(text)
