"""Column functions over text: lines, tokens, features, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become tokens.
STOP = ("the", "a", "an", "is", "are", "of", "in", "on", "for", "to", "and", "or", "this", "that", "with", "it", "as", "by", "be", "from", "at", "was", "were")


def line_count(text: Column) -> Column:
    """Line feeds plus one; 0 for an empty text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)


def split_lines(text: Column) -> Column:
    """Lines by any line boundary, without an empty one at the end."""
    parts = F.split(text, "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """Identifier parts and numbers: lower-cased, split at underscores, without stop words, plural s dropped."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0)), F.lower)
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "_+"))), lambda p: (F.length(p) > 1) & ~p.isin(*STOP))
    plural = lambda p: (F.length(p) > 4) & p.endswith("s") & ~p.endswith("ss")
    return F.transform(parts, lambda p: F.when(plural(p), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))


def trigrams(token: Column) -> Column:
    """Three-letter pieces of a token between ^ and $."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def bucket_md5(feature: Column, buckets: int = 4096) -> Column:
    return (F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def bucket_crc32(feature: Column, buckets: int = 4096) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def masked(text: Column) -> Column:
    """Long runs of token characters keep four of them."""
    return F.regexp_replace(text, "([A-Za-z0-9_/+-]{4})[A-Za-z0-9_/+-]{12,}", "$1***")
