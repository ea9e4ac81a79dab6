"""Texts: sections, HTML, rule candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the name of what precedes the first heading.
INTRODUCTION = "introducción"
# Signs of business rules in code, by name.
SIGNALS = {
    "conditional-validation": r"(?i)\b(if|switch|when)\b.*(cliente|pedido|factura|precio|importe|descuento|aprobaci|prepag|recargo|customer|order|invoice|price|discount|approv|payment)",
    "business-constant": r"(?i)\b(const|final|static)\b.*=\s*[0-9][0-9_.]*\s*[;,]?\s*(//|/\*|#)?.*(€|eur|umbral|limite|threshold|max|min|pct|porcentaje|percent)?",
    "reject-throw": r"(?i)\b(throw|reject|abort|deny|block)\w*\s*\(",
    "domain-error-message": r"""(?i)["'`][^"'`]*(no se puede|no permitido|requiere|debe |bloqueado|rechazado|not allowed|requires|must )[^"'`]*["'`]""",
    "calculation": r"(?i)\b(calcular?|calc|compute|aplicar|apply)\w*\s*\(",
}
# Files that are looked at, and folders that aren't.
INCLUDE = r"\.(ts|tsx|js|jsx|py|java|cs|go|rb|php)$"
EXCLUDE = r"(node_modules|dist|build|\.git|test|spec|__tests__|migrations|vendor)"


def sections(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, section, heading, label, content. A line of one to four # and a blank starts a section, whose
    number is the number of headings so far; what precedes the first is the introduction, number 0. Contents are trimmed; blank
    sections drop, but their headings count."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pattern = r"^#{1,4}\s+(.*)\z"
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    line = line.withColumn("is_heading", F.col("line").rlike(pattern).cast("int"))
    line = line.withColumn("head", F.when(F.col("is_heading") == 1, trimmed(F.regexp_extract("line", pattern, 1))))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("part", F.sum("is_heading").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_heading") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    part = line.groupBy("doc_id", "part").agg(F.max("head").alias("head"), trimmed(body).alias("content")).where("content <> ''")
    out = part.withColumn("section", F.col("part").cast("int")).withColumn("heading", F.coalesce("head", F.lit(INTRODUCTION)))
    return out.select("doc_id", "section", "heading", F.concat(F.col("section").cast("string"), F.lit(". "), F.col("heading")).alias("label"), "content")


def titles(docs: DataFrame) -> DataFrame:
    """doc_id, title: the first heading, or the id."""
    return docs.select("doc_id", F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#{1,4}\s+(\S.*)$", 1)), F.lit("")), F.col("doc_id").cast("string")).alias("title"))


def html_text(html: Column | str) -> Column:
    """HTML as text that `sections` takes: headings become # lines, blocks new lines, list items dashes; tags go, entities are
    decoded once."""
    c = F.col(html) if isinstance(html, str) else html
    for block in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{block}\b.*?</{block}\s*>", "")
    for n in range(1, 5):
        c = F.regexp_replace(c, rf"(?i)<h{n}(\s[^>]*)?>", "\n" + "#" * n + " ")
    c = F.regexp_replace(c, r"(?i)</h[1-4]\s*>", "\n")
    c = F.regexp_replace(c, r"(?i)</?h[56](\s[^>]*)?>", "\n")
    c = F.regexp_replace(c, r"(?i)<li(\s[^>]*)?>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</?(p|ul|ol|table|tr|br)(\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?t[dh](\s[^>]*)?>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def rule_candidates(files: DataFrame, limit: int | None = 200, after: int = 8, include: str | None = INCLUDE, exclude: str | None = EXCLUDE, signals: dict[str, str] | None = None, changed: DataFrame | None = None) -> DataFrame:
    """files (path, text) -> path, line_start, line_end, signals, snippet: spans around lines that show a signal, from two lines
    before to `after` lines behind; further hits inside a span are part of it. changed (path) restricts the scan."""
    f = files.where(F.col("path").rlike(include)) if include else files
    f = f.where(~F.col("path").rlike(exclude)) if exclude else f
    f = f if changed is None else f.join(changed.select("path").distinct(), "path", "left_semi")
    f = f.withColumn("lines", F.split("text", "\n"))
    found = [F.when(F.regexp_like(F.col("_x"), F.lit(p)), F.lit(n)) for n, p in (signals or SIGNALS).items()]
    line = f.select("path", F.posexplode("lines").alias("i", "_x")).select("path", "i", F.array_compact(F.array(*found)).alias("signals")).where(F.size("signals") > 0)
    hits = line.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "signals"))).alias("hits"))
    start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<struct<i:int,signals:array<string>>>").alias("out"))
    kept = F.aggregate("hits", start, lambda a, h: F.when(h["i"] <= a["until"], a).otherwise(F.struct((h["i"] + after).alias("until"), F.concat(a["out"], F.array(h)).alias("out"))), lambda a: a["out"])
    out = hits.select("path", F.explode(kept).alias("h")).join(f.select("path", "lines"), "path")
    first, last = F.greatest(F.lit(0), F.col("h.i") - 2), F.least(F.size("lines") - 1, F.col("h.i") + after)
    out = out.select("path", (first + 1).alias("line_start"), (last + 1).alias("line_end"), F.array_join("h.signals", ",").alias("signals"), F.array_join(F.slice("lines", first + 1, last - first + 1), "\n").alias("snippet")).orderBy("path", "line_start")
    return out.limit(limit) if limit else out
