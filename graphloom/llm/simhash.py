"""Near-duplicates by SimHash over an inverted index of byte positions with count filtering (numbered operator 5).

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so at least 4 positional bytes
agree. A list per single positional byte would hold a 256th of all fingerprints; lists are kept instead for triples of
positions, chosen so that any 4 positions contain a chosen triple (20 of the 56 triples do). Within a list the agreeing
positional bytes are counted for each pair, pairs with 4 or more are kept, and their differing bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORDS, filter_cells, materialise, maybe_in, row_key, text_chunks, tokens
from .components import connected_components
from .neardup import similar_groups

#: Rows of one index list that a task compares with each other at most; longer lists are dealt as pairs of blocks.
BLOCK = 1024


def triples() -> list[tuple[int, int, int]]:
    """Triples of 8 positions such that every 4 positions contain one: with the positions in three groups, those inside one
    group, and those with two positions in a group and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t: tuple[int, int, int]) -> bool:
        n = [sum(group[p] == g for p in t) for g in range(3)]
        return 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(8), 3) if chosen(t)]


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 4, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint for each document: bit b is 1 if it is set in over half the XXH64 values of its word shingles."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    starts, ends, doc = tokens(data, offsets)
    if not len(starts):
        return out
    full = WORDS[data] != 0
    kept = full.copy()
    kept[1:] |= full[:-1]  # the first blank after a word stays, as a space
    before = np.concatenate([[0], np.cumsum(kept)])
    text = np.where(full, LOWER[data], np.uint8(32))[kept].tobytes()
    at, to = before[starts].tolist(), before[ends].tolist()
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.append(first, len(doc)))
    short = count < words
    shingle = np.flatnonzero(np.r_[doc[words - 1 :] == doc[: len(doc) - words + 1], np.zeros(min(words - 1, len(doc)), bool)][: len(doc)]) if len(doc) >= words else np.empty(0, np.int64)
    begins = np.concatenate([shingle, first[short]])
    last = np.concatenate([shingle + words - 1, first[short] + count[short] - 1])
    order = np.argsort(begins, kind="stable")
    begins, last = begins[order], last[order]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[at[b] : to[e]], seed) for b, e in zip(begins.tolist(), last.tolist())], np.uint64)
    own = doc[begins]
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.append(cut, len(own)))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[own[cut]] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, *ids: str, words: int = 4) -> DataFrame:
    """docs (ids..., text) -> (ids..., fp long) from shingles of so many words; null or empty text has fingerprint 0."""
    schema = T.StructType([*(docs.schema[c] for c in ids), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [fingerprints(data, offsets, words) for _, _, data, offsets in text_chunks(b.column(len(ids)))]
            fp = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], pa.array(fp)], names=[*ids, "fp"])

    return docs.select(*ids, "text").mapInArrow(run, schema)


def links_within(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints (uint64, distinct): all of `left`, or left's and right's union
    when right is given. Positional bytes are tallied for each pair first, then bits."""
    x = left if right is None else np.concatenate([left, right])
    n = len(x)
    part = np.arange(n)
    rows = x.view(np.uint8).reshape(n, 8)
    out = []
    for i in range(n - 1):
        near = np.flatnonzero((rows[i + 1 :] == rows[i]).sum(1) >= 8 - bits) + i + 1
        near = near[part[near] != part[i]]
        near = near[np.bitwise_count(x[near] ^ x[i]) <= bits]
        if len(near):
            joined, first = np.unique(part[near], return_index=True)
            out += [(int(x[i]), int(x[j])) for j in near[first].tolist()]
            part[np.isin(part, joined)] = part[i]
    return out


def _forest(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (list, block pair, fp) in this order -> links. A list's rows may go on in the next batch."""
    held: list[np.ndarray] = []

    def flush(key: np.ndarray, fp: np.ndarray, last: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        cuts = np.r_[0, edge, len(fp)]
        done = len(cuts) - 1 if last else len(cuts) - 2
        found: list[tuple[int, int]] = []
        sizes = np.diff(cuts)[:done]
        two = cuts[:done][sizes == 2]
        if len(two):
            a, b = fp[two], fp[two + 1]
            bytes_equal = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(1)
            ok = (bytes_equal >= 8 - bits) & (np.bitwise_count(a ^ b) <= bits)
            found += zip(a[ok].tolist(), b[ok].tolist())
        for k in np.flatnonzero(sizes > 2):
            found += links_within(fp[cuts[k] : cuts[k + 1]], None, bits)
        return cuts[done], found

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    key, fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
    for b in batches:
        key = np.concatenate([key, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)])
        fp = np.concatenate([fp, b.column(2).to_numpy().view(np.uint64)])
        if len(fp) > 1:
            done, found = flush(key, fp, False)
            key, fp = key[done:], fp[done:]
            if found:
                yield batch(found)
    if len(fp) > 1:
        yield batch(flush(key, fp, True)[1])


def near_links(prints: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """prints (fp long, distinct) -> (a, b): links that connect whatever fingerprints within `bits` bits (4 at most)
    connect. Not all pairs: a list gives a spanning forest of its own."""
    if not 0 <= bits <= 4:
        raise ValueError("the index of triples finds pairs up to 4 bits apart")

    def byte(p: int):
        return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))

    keys = [F.lit(k << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(triples())]
    lists = prints.select("fp", F.explode(F.array(*keys)).alias("list"))
    sizes = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    dealt = lists.join(sizes, "list").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("list", (F.least("own", "other") * 1_000_000 + F.greatest("own", "other")).alias("pair"), "fp")
    dealt = dealt.repartition("list", "pair").sortWithinPartitions("list", "pair", "fp")
    return dealt.mapInArrow(lambda batches: _forest(batches, bits), "a long, b long")


def _components(prints: DataFrame, bits: int, block: int) -> DataFrame:
    """prints (doc_id, fp) -> fp, component (the least fingerprint that links reach), component_id (the least doc_id)."""
    own = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(near_links(own.select("fp"), bits, block))
    joined = own.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = materialise(joined, "joined")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(smallest, "component").select("fp", "component", "component_id")


def simhash_components(docs: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links between fingerprints at most `bits` bits apart reach, the row's own
    included. Texts are lower-cased in A-Z; shingles are 4 words joined by a space (a shorter text's whole sequence); null,
    empty and blank texts have fingerprint 0 and link like any other. Repeated rows come out as often as they came; rows
    with a null doc_id take part, and get a null component_id if they reach no id. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialise(with_fingerprint(docs, "doc_id"), "fingerprints")
    named = _components(prints, bits, block)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def merge_groups(parts: DataFrame, others: DataFrame) -> DataFrame:
    """parts and others (component, at: none, doc_id, rk), each with all rows -> parts with components joined where others' are
    one."""
    both = parts.select(F.col("at.rk").alias("rk"), F.col("component").alias("a")).join(others.select(F.col("at.rk").alias("rk"), F.col("component").alias("b")), "rk")
    both = materialise(both.select("a", "b").distinct(), "both")
    least = both.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("n")).where("n > 1")
    merged = connected_components(both.join(least, "b").select("a", F.col("least").alias("b")))
    out = parts.join(merged.withColumnRenamed("component", "whole"), parts["component"] == merged["id"], "left")
    return materialise(out.select(F.coalesce("whole", "component").alias("component"), "at"), "parts")


def drop_near_duplicates(docs: DataFrame, bits: int = 4, words: int = 5, similarity: float | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs (doc_id, text, ...), with their columns, that stay when one row of each group does: that with the
    smallest doc_id (null last; ties by a hash of the text, then any of equal rows).

    Documents are linked if their fingerprints differ in at most `bits` of 64 bits. Fingerprints tell only part of the pairs of
    middling similarity: with `similarity`, documents whose shingle sets have that Jaccard similarity or more are linked too,
    every pair of them. That costs a comparison for each pair of a group that is nearly, but not quite, so similar.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", row_key(), "text")
    prints = materialise(with_fingerprint(rows, "doc_id", "rk", words=words), "fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk").alias("at")
    parts = materialise(prints.join(_components(prints, bits, block), "fp").select("component", at), "parts")
    if similarity is not None:
        parts = merge_groups(parts, similar_groups(rows, similarity, words))
    return keep_first(docs, parts)


def keep_first(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of docs that stay when one of each component does; parts (component, at: none, doc_id, rk) has all rows."""
    first = parts.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    grouped = parts.join(materialise(first, "first"), "component")  # Spark can split a large component's rows
    status = grouped.groupBy(F.col("at.rk").alias("k")).agg(F.min(F.col("at") == F.col("first")).alias("stays"))
    status = materialise(status, "status")
    known = filter_cells(status.select(F.col("k").alias("h")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key())
    joined = maybe_in(rows, F.col("rk"), known).join(status, F.col("rk") == F.col("k"), "left")
    again = joined.where("stays").dropDuplicates(["rk"])
    return maybe_in(rows, F.col("rk"), known, False).select("row.*").unionByName(joined.where("k is null").select("row.*")).unionByName(again.select("row.*"))
