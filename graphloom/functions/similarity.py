"""String and vector similarity, rounding, and hop weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EDGE_WEIGHTS
from .text import _stripped, normalize_text, tokens


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def singular_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.transform(tokens(c), lambda t: _stripped(t, "s", 3)))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal normal forms, 0 if one alone is empty; else the larger of edit similarity and token Jaccard."""
    x, y, s, t = normalize_text(a), normalize_text(b), singular_tokens(a), singular_tokens(b)
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    union = F.size(F.array_union(s, t))
    jaccard = F.when(union > 0, F.size(F.array_intersect(s, t)) / union).otherwise(0.0)
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.greatest(edit, jaccard))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if a vector is all zeros; an error if their lengths differ."""
    n = norm(a) * norm(b)
    value = F.when(n > 0, dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths").cast("double")).otherwise(value)


def calibrated(c: Column | str, floor: float) -> Column:
    c = _col(c)
    return F.greatest(F.lit(0.0), (c - floor) / (1 - floor)) if floor > 0 else c


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def round4(c: Column | str) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(_col(c) * 10000 + 0.5) / 10000


def edge_weight(type_: Column | str = "type", confidence: Column | str = "confidence") -> Column:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])[_col(type_)], F.lit(0.75))
    return clamp(confidence, 0.01, 1.0) * weight


def hop_cost(weight: Column | str) -> Column:
    return -F.log(clamp(weight, 1e-6, 1.0))
