"""Line de-duplication by an exact set-similarity join (numbered operator 10), in DataFrame functions alone.

A line's tokens are its distinct words, ordered by rarity. Two lines whose Jaccard similarity is t or more share a token among
the first n - ceil(t n) + 1 of each, at places that leave room for the overlap needed, and their sizes are within a factor t.
Candidates pass these prefix, length and positional filters and a bound on the bits by which parities of the tokens differ;
they are verified on the words themselves. Equal token sets are one class throughout: copies of a line are counted and
ordered, never paired.

A line goes if any earlier line matches it, so one match is enough, and pairs are never written out: semi-joins under the prefix
tokens find the classes that have an earlier candidate, then the classes that are candidates of those, and at last, with the
texts of these few classes at hand, the classes that have an earlier match. A member of a large group of near copies is done
with at the first match; it is looked up under its rarest shared token first, and under all only if that finds none.

Rarity comes from a table of word counts of bounded size (words that share a cell add up), which is exact enough to order by:
any fixed order gives right results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_at, discard, filter_cells, materialise, maybe_in, row_key, stored_list

#: Cells of the table of word counts (a byte each in the plan).
CELLS = 1 << 18
#: Items of the bitmap that tells which tokens may be wanted, of 64 bits each.
BITMAP = 1 << 18
MASK = (1 << 48) - 1
#: Distinct words from which a line has 128 parities, rather than 64.
LONG = 48


def split_words(line: Column) -> Column:
    """Words of a line, lower-cased: what white space parts. Blanks in a row part empty words."""
    other = "\r\t\x0b\x0c"
    odd = F.contains(line, F.lit(other[0]))
    for c in other[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.lower(F.when(odd, F.translate(line, other, " " * len(other))).otherwise(line)), " ")


def word_set(line: Column) -> Column:
    return F.array_remove(F.array_distinct(split_words(line)), "")


def line_rows(docs: DataFrame) -> DataFrame:
    """rk, doc_id, line_no, line: the lines of docs (doc_id, text)."""
    keyed = docs.select(row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")  # else each line would hash the whole text
    return keyed.select("rk", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def rarity(docs: DataFrame) -> bytes:
    """Per cell 1 + log2 of the count of all words that hash to it."""
    words = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.explode(split_words(F.col("line"))).alias("w"))
    found = words.groupBy(_cell(F.xxhash64("w")).alias("cell")).agg(F.count("*").alias("n")).toPandas()  # CELLS rows at most
    table = bytearray(CELLS)
    for cell, n in zip(found["cell"], found["n"]):
        table[cell] = min(127, 1 + int(math.log2(n)))
    return bytes(table)


def _bit(token: Column) -> tuple[Column, Column]:
    """The item of a bitmap that has the token, and the token's bit in it."""
    h = F.xxhash64(token)
    return F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(tokens: DataFrame) -> DataFrame:
    """Marks the tokens (column token); BITMAP rows at most reach the driver. One stored row."""
    at, bit = _bit(F.col("token"))
    bits = tokens.select(at.alias("at"), bit.alias("bit"))
    found, table = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas(), np.zeros(BITMAP, np.int64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return stored_list(tokens.sparkSession, table, "bitmap")


def marked(token: Column, table: DataFrame) -> Column:
    """Whether a bitmap has a token: always for those that it was made of, seldom for others while it isn't full."""
    at, bit = _bit(token)
    return table.scalar()[at].bitwiseAND(bit) != 0


def tokenised(docs: DataFrame, ranks: bytes, num: int, den: int) -> DataFrame:
    """doc_id, rk, line_no, n (distinct words), s1 and s2 (hashes of the token set), prefix, sig, sig2.

    sig, sig2: 128 bits, each the parity of the number of tokens that hash to it. Sets that differ in d tokens differ in d bits at
    most, and large sets don't fill them up. Smaller sets have the 64 bits of both halves together, in sig alone."""

    def key(h: Column) -> Column:
        return F.shiftleft(byte_at(ranks, _cell(h)).cast("long"), 48).bitwiseOR(h.bitwiseAND(F.lit(MASK)))

    hashes = F.array_remove(F.array_distinct(F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    rows = line_rows(docs).select("doc_id", "rk", "line_no", F.sort_array(F.transform(hashes, key)).alias("keys")).withColumn("n", F.size("keys"))
    least = F.floor((F.col("n").cast("long") * num + den - 1) / den).cast("int")  # overlap with the shortest partner: ceil(t n)
    prefix = F.transform(F.slice("keys", 1, F.col("n") - least + 1), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    bit = "shiftleft(1L, cast(k & 63 as int))"
    half = f"aggregate(keys, 0L, (a, k) -> if((k & 64) = {{}}, a ^ {bit}, a))"
    sig = F.when(F.col("n") < LONG, F.expr(f"aggregate(keys, 0L, (a, k) -> a ^ {bit})")).otherwise(F.expr(half.format(0)))
    sig2 = F.when(F.col("n") < LONG, F.lit(0).cast("long")).otherwise(F.expr(half.format(64)))
    return rows.select("doc_id", "rk", "line_no", "n", F.xxhash64("keys").alias("s1"), F.hash("keys").alias("s2"), prefix.alias("prefix"), sig.alias("sig"), sig2.alias("sig2"))


def _size(np: Column) -> Column:
    return F.shiftright(np, 31)


def _place(np: Column) -> Column:
    return np.bitwiseAND(F.lit((1 << 31) - 1))


def _candidates(num: int, den: int, x: str, y: str) -> Column:
    """Whether rows of one token (np: size and place of the token, sig, sig2) can be of similar sets.

    Sizes are within the threshold; what is left after the places leaves room for the overlap; and the parities differ in no
    more bits than the sets may differ in tokens.
    """
    nx, ny = _size(F.col(f"{x}.np")), _size(F.col(f"{y}.np"))
    room = F.least(nx - _place(F.col(f"{x}.np")), ny - _place(F.col(f"{y}.np")))
    fits = (ny * den >= nx * num) & (nx * den >= ny * num) & (room * (num + den) >= (nx + ny) * num)
    same = (F.col(f"{x}.token") == F.col(f"{y}.token")) & (F.col(f"{x}.s1") != F.col(f"{y}.s1"))
    one, two = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("sig", "sig2"))
    bits = F.when((nx < LONG) | (ny < LONG), F.bit_count(one.bitwiseXOR(two))).otherwise(F.bit_count(one) + F.bit_count(two))
    return same & fits & (bits * (num + den) <= (nx + ny) * (den - num))


def _first_lines(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """s1, at, words (the word set) of the wanted classes (s1): their first lines, which are read from docs again."""
    spots = materialise(classes.join(wanted.distinct(), "s1", "left_semi").select("s1", "doc_id", "rk", "line_no"), "spots")
    known, theirs = filter_cells(spots.select(F.xxhash64("rk", "line_no").alias("h"))), filter_cells(spots.select(F.col("rk").alias("h")))
    keyed = maybe_in(docs.select(row_key(), "text"), F.col("rk"), theirs)  # other documents aren't parted into lines
    lines = maybe_in(keyed.select("rk", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")), F.xxhash64("rk", "line_no"), known)
    found = lines.join(spots, ["rk", "line_no"]).select("s1", F.struct("doc_id", "rk", "line_no").alias("at"), "line").dropDuplicates(["s1"])  # repeated rows have the same lines
    out = materialise(found.select("s1", "at", word_set(F.col("line")).alias("words")), "first-lines")
    discard(spots, known, theirs)
    return out


def repeated_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """doc_id, rk, line_no of the lines that match an earlier line; see `dedup_lines`."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be within 0.5 and 1")
    num, den = round(threshold * 1000), 1000
    docs = docs.select("doc_id", "text").where("text is not null")
    whole = materialise(tokenised(docs, rarity(docs), num, den), "lines")
    lines, n = whole.where(F.col("n") >= min_words), F.col("n")
    place = F.struct("doc_id", "rk", "line_no")
    classes = lines.groupBy("s1", "s2", "n").agg(F.min(F.struct(place.alias("at"), "prefix", "sig", "sig2")).alias("m"))
    classes = materialise(classes.select("s1", "n", "m.at.*", "m.prefix", "m.sig", "m.sig2"), "classes")
    lines = materialise(lines.select("doc_id", "rk", "line_no", "s1"), "line-classes")  # all that is still wanted of a line
    discard(whole)
    # Smaller sets match equal ones alone: n / (n + 1) is under the threshold.
    tokens = classes.where(n * (den - num) >= num).select("s1", "n", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "sig", "sig2", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.select("token", "doc", "s1", (n.cast("long") * (1 << 31) + F.col("pos")).alias("np"), "sig", "sig2")

    # Of two classes in one document either may be the later one.
    order = F.col("x.doc") <= F.col("y.doc")
    later = tokens.alias("y").join(tokens.alias("x"), _candidates(num, den, "x", "y") & order, "left_semi")
    later = materialise(later, "later")
    discard()

    def matched(some: DataFrame) -> DataFrame:
        """s1 of the classes of some (rows of later) that have an earlier match."""
        some = materialise(some, "open")
        wanted = bitmap(some)
        earlier = tokens.where(marked(F.col("token"), wanted)).alias("x").join(some.alias("y"), _candidates(num, den, "x", "y") & order, "left_semi")
        earlier = materialise(earlier, "earlier")
        texts = _first_lines(docs, classes, some.select("s1").union(earlier.select("s1")))
        y, x = some.join(texts, "s1").alias("y"), earlier.join(texts, "s1").alias("x")
        wx, wy = F.col("x.words"), F.col("y.words")
        similar = F.size(F.array_intersect(wx, wy)).cast("long") * (num + den) >= (F.size(wx) + F.size(wy)).cast("long") * num
        before = F.col("x.at") < F.col("y.at")
        out = materialise(y.join(x, _candidates(num, den, "x", "y") & before & similar, "left_semi").select("s1").distinct(), "matched")
        discard(some, wanted, earlier, texts)
        return out

    rarest = later.groupBy("s1").agg(F.min("np").alias("np"))  # under their rarest token first
    found = matched(later.join(rarest, ["s1", "np"]))
    rest = matched(later.join(found, "s1", "left_anti"))
    # A class's first line stays unless an earlier class matches it; its other lines go.
    stays = classes.select("s1", place.alias("at")).join(found.unionByName(rest), "s1", "left_anti")
    gone = materialise(lines.select(place.alias("at"), "s1").join(stays, ["s1", "at"], "left_anti").select("at.*"), "repeated")
    discard(lines, classes, later, found, rest)
    return gone


def dedup_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) with the lines taken out of text that match an earlier line, and all other columns.

    Added columns (replaced if there): n_lines and n_removed, both long. Lines are what newlines part; their tokens are
    distinct words, lower-cased. Lines match if the Jaccard similarity of their token sets is `threshold` or more. A line is
    earlier by doc_id (null first), then by the text's hash for rows of one doc_id, then by line number. Every line that
    matches any earlier line of the input goes, whether that line stays or not. Lines of fewer than `min_words` distinct words
    always stay: blank ones, by default. Rows equal in doc_id and text are one document and get one result. A document that
    loses all its lines gets an empty text. Null and empty texts stay as they are, with n_lines 0.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = materialise(repeated_lines(docs, threshold, min_words).groupBy("doc_id", "rk").agg(F.collect_set("line_no").alias("gone")), "gone")
    known = filter_cells(gone.select(F.col("rk").alias("h")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key())
    split = F.split("row.text", "\n", -1)
    total = F.when(F.coalesce(F.col("row.text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines")

    def named(text: Column, removed: Column) -> list[Column]:
        return [*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], total, removed.cast("long").alias("n_removed")]

    # Whole texts are exchanged, but not sorted: the other side has a short row a document.
    theirs = gone.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "gone").hint("shuffle_hash")
    same = (F.col("rk") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    hit = maybe_in(rows, F.col("rk"), known).join(theirs, same, "left")
    stays = F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), F.array_contains("gone", i).alias("gone"))), lambda s: ~s["gone"])
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stays, lambda s: s["x"]), "\n"))
    hit = hit.select(*named(text, F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))))
    return hit.unionByName(maybe_in(rows, F.col("rk"), known, False).select(*named(F.col("row.text"), F.lit(0))))
