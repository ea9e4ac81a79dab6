"""Folding, tokens, segments and identifiers of text columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one letter and marks, and these letters."""
    one = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x250)]
    more = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in one + more if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def fold(c: Column | str) -> Column:
    """Lower case without diacritics (Latin letters; combining marks go)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.translate(c, _FROM, _TO), "[\\u0300-\\u036F]", ""))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def normalize_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def normalize_alias(c: Column | str) -> Column:
    """Folding for alias comparison: punctuation stays."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def _stripped(t: Column, end: str, longer_than: int) -> Column:
    return F.when(F.length(t).__gt__(longer_than) & t.endswith(end), F.substring(t, F.lit(1), F.length(t) - len(end))).otherwise(t)


def match_keys(c: Column | str) -> Column:
    """The normal form, and it with an s, or an es, taken off each token."""
    t = tokens(c)
    return F.array_distinct(F.array(normalize_text(c), F.array_join(F.transform(t, lambda x: _stripped(x, "s", 3)), " "), F.array_join(F.transform(t, lambda x: _stripped(x, "es", 4)), " ")))


def first_line(c: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(c, "\n", 1), r"^\s+|\s+$", "")


def segments(c: Column | str, shortest: int = 15, most: int = 5) -> Column:
    """Sentences and lines of a description; a piece shorter than `shortest` joins the one before it; at most `most`."""
    c = F.col(c) if isinstance(c, str) else c
    pieces = F.filter(F.transform(F.split(c, r"\n+|(?<=[.!?;])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def join(acc: Column, x: Column) -> Column:
        last = F.concat(F.element_at(acc, -1), F.lit(" "), x)
        return F.when((F.length(x) < shortest) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last))).otherwise(F.concat(acc, F.array(x)))

    return F.slice(F.aggregate(pieces, empty, join), 1, most)


def embedding_text(type_: Column | str, name: Column | str, aliases: Column | str, description: Column | str, mention: Column | None = None) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    more = [] if mention is None else [F.when(mention != name, mention)]
    return F.concat_ws(" ", type_, name, *more, F.array_join(aliases, " "), description)


def clip_excerpt(c: Column | str, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)
