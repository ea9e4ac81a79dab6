"""Groups of near-duplicates by exact Jaccard similarity of word shingles, which complete those by fingerprints (operator 5).

Two shingle sets whose similarity is t or more share a shingle among the first n - ceil(t n) + 1 of each, in any fixed order;
documents are joined on these, with length and positional filters, and verified on whole sets. Shingles are ordered by a table
of counts of bounded size, so common ones come last. Equal sets are one class. Of the documents under one shingle each is first compared
with the first one and with the one before it; after that only pairs that links don't connect yet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, discard, filter_cells, materialise, maybe_in, mix, prefix_hashes, range_hashes, shingle_hashes, text_chunks, tokens
from .components import connected_components

#: Cells of the table of shingle counts.
CELLS = 1 << 16
#: Bits of a sketch, each the parity of the number of shingles that hash to it: sets that differ in d shingles differ in d bits at most.
BITS = 1024


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of word shingles, and their documents, in order of documents. A text of fewer words has its whole
    sequence, one without words has 0."""
    starts, ends, doc = tokens(data, offsets)
    blank = np.ones(len(offsets) - 1, bool)
    blank[doc] = False
    hashes, docs = [np.zeros(blank.sum(), np.uint64)], [np.flatnonzero(blank)]
    if len(starts):
        h = range_hashes(prefix_hashes(LOWER[data]), starts, ends)
        count = np.bincount(doc)[doc]
        for k in range(1, words + 1):
            own = count >= words if k == words else count == k
            x, at = shingle_hashes(h[own], doc[own], k)
            hashes.append(mix(x + np.uint64(k)))
            docs.append(doc[own][at])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    return h[new], d[new]


def _ranks(docs: DataFrame, words: int) -> np.ndarray:
    """Per cell the log2 of the count of all shingles that hash to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                n += np.bincount((shingles(data, offsets, words)[0] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    counts = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.int8)
    out[counts["cell"].to_numpy(np.int64)] = np.log2(counts["n"].to_numpy(float)).astype(np.int8)
    return out


def sketches(h: np.ndarray, d: np.ndarray, rows: int, step: int = 1024) -> pa.Array:
    """A sketch of BITS / 8 bytes for each of so many documents, from shingle hashes in order of their documents."""
    out = np.empty((rows, BITS // 8), np.uint8)
    cell = ((h >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
    for first in range(0, rows, step):
        end = min(rows, first + step)
        a, b = np.searchsorted(d, [first, end])
        table = np.bincount((d[a:b] - first) * BITS + cell[a:b], minlength=(end - first) * BITS)
        out[first:end] = np.packbits((table & 1).astype(np.uint8).reshape(-1, BITS), axis=1)
    return pa.array([x.tobytes() for x in out], pa.binary())


def _prefixes(docs: DataFrame, words: int, ranks: np.ndarray, num: int, den: int) -> DataFrame:
    """docs (doc_id, rk, text) -> doc_id, rk, s1 (a hash of the set), n, sketch, prefix: the tokens to join on, cut to 32 bits
    (more candidates, but no pair is lost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(2)):
                h, d = shingles(data, offsets, words)
                cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                n = np.diff(np.append(cut, len(d)))
                s1 = mix(np.add.reduceat(mix(h + np.uint64(1)), cut))
                sketch = sketches(h, d, end - first)
                h = h[np.lexsort((h, ranks[(h % np.uint64(CELLS)).astype(np.int64)], d))]
                size = n - (n * num + den - 1) // den + 1
                h = (h[np.arange(len(d)) - np.repeat(cut, n) < np.repeat(size, n)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in b.columns[:2]), pa.array(s1.view(np.int64)), pa.array(n.astype(np.int32)), sketch, prefix], names=["doc_id", "rk", "s1", "n", "sketch", "prefix"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "doc_id long, rk long, s1 long, n int, sketch binary, prefix array<int>")


def jaccard_at_least(left: pa.Array, right: pa.Array, words: int, num: int, den: int) -> np.ndarray:
    """For each row of two columns of texts: whether the shingle sets' similarity is num / den or more."""
    out = np.zeros(len(left), bool)
    for first, end, *one in text_chunks(left):
        rows = end - first
        _, _, *two = next(text_chunks(right.slice(first, rows), 1 << 62))
        (ha, da), (hb, db) = shingles(*one, words), shingles(*two, words)
        h, d = np.concatenate([ha, hb]), np.concatenate([da, db])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=rows)
        out[first:end] = both * (num + den) >= np.bincount(d, minlength=rows) * num
    return out


def _near_sketches(classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sketches permit the similarity: all that have it, and few others."""
    spots = classes.select("s1", "n", "sketch")
    both = pairs.join(spots.toDF("a", "na", "sa"), "a").join(spots.toDF("b", "nb", "sb"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BITS // 8) for k in (3, 4))
            bits = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            good = pa.array(bits * (num + den) <= b.column(2).to_numpy().astype(np.int64) * (den - num))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(good) for k in range(2)], names=["a", "b"])

    return materialise(both.mapInArrow(run, "a long, b long"), "near-pairs")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sets are similar. Their texts are brought together, as these are smaller than sets."""
    pairs = _near_sketches(classes, pairs, num, den)
    spots = classes.select("s1", F.col("at.rk").alias("rk"))
    both = materialise(pairs.join(spots.toDF("a", "ra"), "a").join(spots.toDF("b", "rb"), "b").select("a", "b", "ra", "rb"), "placed-pairs")
    known = filter_cells(both.select("ra").union(both.select("rb")).select(F.col("ra").alias("h")))
    texts = maybe_in(docs.select("rk", "text"), F.col("rk"), known).dropDuplicates(["rk"])
    met = both.join(texts.toDF("ra", "ta"), "ra").join(texts.toDF("rb", "tb"), "rb").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = pa.array(jaccard_at_least(b.column(2), b.column(3), words, num, den)) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(good) for k in range(2)], names=["a", "b"])

    out = materialise(met.mapInArrow(run, "a long, b long"), "similar")
    discard(pairs, both, known)
    return out


def similar_groups(rows: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """rows (doc_id, rk, text) -> component, at (none: doc_id is null; doc_id, rk) for all of them.

    Documents are linked if the Jaccard similarity of their sets of `words`-word shingles is `threshold` or more: every such
    pair is found. Texts are lower-cased in A-Z; a shorter text has its whole sequence; null, empty and blank texts are alike.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be within 0.5 and 1")
    num, den = round(threshold * 1000), 1000
    sets = _prefixes(rows, words, _ranks(rows, words), num, den)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk").alias("at")
    sets = materialise(sets.select("s1", "n", at, "sketch", "prefix"), "sets")
    classes = sets.groupBy("s1", "n").agg(F.min(F.struct("at", "sketch", "prefix")).alias("m")).select("s1", "n", "m.at", "m.sketch", "m.prefix")
    classes = materialise(classes, "classes")
    # np: the set's size and the token's place.
    items = classes.select("s1", "n", F.posexplode("prefix").alias("pos", "token"))
    items = items.select("token", F.struct("s1", (F.col("n").cast("long") * (1 << 31) + F.col("pos")).alias("np")).alias("y"))
    in_order = W.partitionBy("token").orderBy("y.s1")
    met = items.select("token", "y", F.first("y").over(in_order).alias("first"), F.lag("y").over(in_order).alias("before"), F.lead("y").over(in_order).isNotNull().alias("more"))
    items = materialise(met.where(F.col("before").isNotNull() | F.col("more")), "items")
    discard()

    def fits(x: str, y: str) -> Column:
        size, place = (lambda c: F.shiftright(F.col(f"{c}.np"), 31)), (lambda c: F.col(f"{c}.np").bitwiseAND(F.lit((1 << 31) - 1)))
        na, nb = size(x), size(y)
        return (nb * den >= na * num) & (na * den >= nb * num) & (F.least(na - place(x), nb - place(y)) * (num + den) >= (na + nb) * num)

    def pairs(met: DataFrame) -> DataFrame:
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # Each is compared with the one that it meets most often.
    first = items.where("before is not null").select("y", F.explode(F.array("first", "before")).alias("x"))
    first = first.where((F.col("x.s1") != F.col("y.s1")) & fits("x", "y")).groupBy(F.col("y.s1").alias("y"), F.col("x.s1").alias("x")).agg(F.count("*").alias("k"))
    most = F.col("k") * (1 << 40) + F.col("x").bitwiseAND(F.lit((1 << 40) - 1))
    first = materialise(pairs(first.groupBy("y").agg(F.max_by("x", most).alias("x"))), "first-pairs")
    links = _verified(rows, classes, first, words, num, den)
    parts = connected_components(links).withColumnRenamed("id", "s1")
    labelled = items.select("token", "y.s1", "y.np").join(parts, "s1", "left").select("token", "s1", "np", F.coalesce("component", "s1").alias("part"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    labelled = materialise(labelled.join(mixed, "token", "left_semi"), "mixed")
    rest = labelled.alias("x").join(labelled.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.part") < F.col("y.part")) & fits("x", "y"))
    rest = rest.select("x.s1", "y.s1").toDF("x", "y")
    rest = materialise(pairs(rest).join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(rows, classes, rest, words, num, den))
    parts = connected_components(links).withColumnRenamed("id", "s1")
    out = materialise(sets.join(parts, "s1", "left").select(F.coalesce("component", "s1").alias("component"), "at"), "groups")
    discard(sets, classes, items, first, labelled, rest)
    return out
