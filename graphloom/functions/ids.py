"""Identifiers, canonical JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug


def edge_id(type_: Column | str, source: Column | str, target_ref: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", type_, source, target_ref))


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def node_id_for(type_: Column | str, name: Column | str) -> Column:
    """type-slug(name); a slug that starts with the type isn't prefixed again."""
    t, s = (F.col(type_) if isinstance(type_, str) else type_), slug(name)
    return F.when((s == t) | s.startswith(F.concat(t, F.lit("-"))), s).otherwise(F.concat(t, F.lit("-"), s))


def node_ref(type_: Column | str, id_: Column | str) -> Column:
    return F.concat_ws("/", type_, id_)


def ref_id(ref: Column | str) -> Column:
    """What follows the first slash of a reference (all of it without one)."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    return F.when(ref.contains("/"), F.regexp_extract(ref, "^[^/]*/(.*)$", 1)).otherwise(ref)


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys throughout; null for null or malformed text."""
    return F.to_json(F.try_parse_json(c))


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)


def evidence_key(source_type: str = "source_type", locator: str = "locator", excerpt: str = "excerpt", stance: str = "stance") -> Column:
    """Identity of evidence: canonical JSON of source type, locator, excerpt (null: empty) and stance (null: supports)."""
    ex, st = F.coalesce(F.col(excerpt), F.lit("")), F.coalesce(F.col(stance), F.lit("supports"))
    place = F.coalesce(canonical_json(locator), F.lit("null"))
    return F.concat(F.lit('{"excerpt":'), _quoted(ex), F.lit(',"locator":'), place, F.lit(',"source_type":'), _quoted(F.col(source_type)), F.lit(',"stance":'), _quoted(st), F.lit("}"))


def content_hash(provider: str, text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.sha1(F.concat(F.lit(provider), F.lit("\0"), text))
