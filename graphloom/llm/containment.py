"""Benchmark decontamination by size-partitioned MinHash containment search (numbered operator 3).

Test items are partitioned by the number of their shingles into classes (L / 2, L], L a power of two. For each class every
document is cut into windows of 2 L shingles that start every L shingles, so any L successive shingles lie in one window, and
a window's set isn't much larger than an item's: its Jaccard similarity to an item whose shingles it holds to 0.8 is at least
0.19. Each of 64 hash functions whose minimum over the window equals its minimum over an item makes the two a candidate; the
chance that all 64 miss is below 2e-6. Candidates are verified on the whole document by exact containment of shingles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_classes, filter_cells, materialise, maybe_in, prefix_hashes, range_hashes, row_key, shingle_hashes, text_chunks, tokens

WORDS_IN_SHINGLE = 5
FUNCTIONS = 64
#: Shingles in the smallest block whose minima are taken; also the least size class.
GRAIN = 8
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))
#: 0 blanks and ASCII punctuation, 1 letters, digits and bytes of longer UTF-8 sequences.
KINDS = byte_classes(other=bytes(c for c in range(128) if not chr(c).isalnum()))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, documents, hashes) of words: runs of letters and digits, lower-cased in A-Z."""
    starts, ends, doc = tokens(data, offsets, KINDS)
    return starts, ends, doc, range_hashes(prefix_hashes(LOWER[data]), starts, ends)


def exact_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> set[bytes]:
    own = [LOWER[data[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    return {b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)}


@dataclass
class Items:
    """Test items of one block: for each, its shingle length k (5, or its number of words if fewer) and its shingles."""

    ids: list[int] = field(default_factory=list)
    k: list[int] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    exact: list[set[bytes]] = field(default_factory=list)

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Items:
        out = cls()
        for item, text in zip(ids, texts):
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, doc, h = words(data, np.array([0, len(data)]))
            if k := min(WORDS_IN_SHINGLE, len(h)):
                out.ids.append(item)
                out.k.append(k)
                out.hashes.append(np.unique(shingle_hashes(h, doc, k)[0]))
                out.exact.append(exact_shingles(data, starts, ends, k))
        return out


class ContainmentIndex:
    def __init__(self, items: Items, threshold: float):
        self.items, self.threshold = items, threshold
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_class: dict[int, list[int]] = defaultdict(list)
        for i, (k, h) in enumerate(zip(items.k, items.hashes)):
            if k < WORDS_IN_SHINGLE:
                self.short[k][int(h[0])].append(i)
            else:
                by_class[max(GRAIN, 1 << (len(h) - 1).bit_length())].append(i)
        self.classes = {}
        for size, own in sorted(by_class.items()):
            minima = np.stack([self._values(items.hashes[i]).min(1) for i in own], 1)
            order = np.argsort(minima, axis=1, kind="stable")
            seen = np.zeros((FUNCTIONS, 1 << 16), bool)
            np.put_along_axis(seen, (minima & 0xFFFF).astype(np.int64), True, 1)
            self.classes[size] = np.array(own), np.take_along_axis(minima, order, 1), order, seen

    @staticmethod
    def _values(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)).astype(np.uint32)[None, :] * _A[:, None] + _B[:, None]

    def _candidates(self, h: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (document, item) from shingle hashes in order of their documents."""
        if not len(h) or not self.classes:
            return set()
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.append(first, len(doc)))
        blocks = -(-count // GRAIN)
        of = np.repeat(np.arange(len(first)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[of] + nth * GRAIN
        low = (h >> np.uint64(32)).astype(np.uint32)
        out: set[tuple[int, int]] = set()
        starts = {size: np.flatnonzero(nth % (size // GRAIN) == 0) for size in self.classes}
        for f in range(FUNCTIONS):
            least, width = np.minimum.reduceat(low * _A[f] + _B[f], begin), 1
            for size, (own, minima, order, seen) in self.classes.items():
                while width < 2 * size // GRAIN:  # minima of windows twice as wide
                    if width < len(least):
                        least = np.concatenate([np.minimum(least[:-width], least[width:]), least[-width:]])
                    width *= 2
                value = least[starts[size]]
                hit = np.flatnonzero(seen[f][value & np.uint32(0xFFFF)])
                if len(hit):
                    a, b = np.searchsorted(minima[f], value[hit], "left"), np.searchsorted(minima[f], value[hit], "right")
                    for k in np.flatnonzero(b > a).tolist():
                        d = int(doc[begin[starts[size][hit[k]]]])
                        out.update((d, int(own[i])) for i in order[f, a[k] : b[k]].tolist())
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """Document -> (item id, containment) of at least the threshold, by item id."""
        starts, ends, doc, wh = words(data, offsets)
        h, at = shingle_hashes(wh, doc, WORDS_IN_SHINGLE)
        own = doc[at]
        pairs = self._candidates(h, own)
        for k, known in self.short.items():
            short, where = shingle_hashes(wh, doc, k)
            hit = np.isin(short, np.fromiter(known, np.uint64, len(known)))
            pairs |= {(int(doc[where[j]]), i) for j in np.flatnonzero(hit).tolist() for i in known[int(short[j])]}
        by_doc: dict[int, list[int]] = defaultdict(list)
        for d, i in pairs:
            by_doc[d].append(i)
        out: dict[int, list[tuple[int, float]]] = {}
        for d, some in by_doc.items():
            a, b = np.searchsorted(own, [d, d + 1])
            mine = np.unique(h[a:b])
            some = [i for i in some if self.items.k[i] < WORDS_IN_SHINGLE or np.isin(self.items.hashes[i], mine).mean() >= self.threshold]
            if some:
                a, b = np.searchsorted(doc, [d, d + 1])
                exact = {k: exact_shingles(data, starts[a:b], ends[a:b], k) for k in {self.items.k[i] for i in some}}
                share = [(self.items.ids[i], len(self.items.exact[i] & exact[self.items.k[i]]) / len(self.items.exact[i])) for i in some]
                if good := sorted(x for x in share if x[1] >= self.threshold):
                    out[d] = good
        return out


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_items: int = 4096, out: str = "leaks") -> DataFrame:
    """docs (doc_id, text, ...) with a column `out`: array of (item_id, containment) of the test items whose distinct word
    shingles the document holds to `threshold` or more, by item_id; a column of that name is replaced.

    Shingles are 5 words, or all words of a shorter item, which then matches where these words stand in a row. Items without
    words match nothing; null and empty texts hold nothing. A repeated item (same id or not) matches as often as it is
    there. Items are taken in blocks of about `block_items`. Each block is a job of its own, which reads the documents and
    writes what it finds; its broadcast is freed before the next, so driver and executors hold one block at a time, however
    many items there are. Rows equal in doc_id and text are one document and get one result.
    """
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    blocks = max(1, -(-items.count() // block_items))
    docs = docs.drop(out)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), row_key(), "text")
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        index = ContainmentIndex(Items.of(own["item_id"].to_pylist(), own["text"].to_pylist()), threshold)
        index.short = {k: dict(v) for k, v in index.short.items()}
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits: dict[int, list[dict]] = {}
                for first, _, data, offsets in text_chunks(b.column(2)):
                    for d, found in sent.value.matches(data, offsets).items():
                        hits[first + d] = [{"item_id": i, "containment": c} for i, c in found]
                at = pa.array(list(hits), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(list(hits.values()), kind)], names=["id", "rk", "found"])

        some = texts.mapInArrow(search, T.StructType([*texts.schema.fields[:2], T.StructField("found", LEAKS)]))
        parts.append(materialise(some.dropDuplicates(["id", "rk"]), "leaks"))
        sent.destroy()
    lists = reduce(DataFrame.unionByName, parts).groupBy("id", "rk").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    known = filter_cells(lists.select(F.col("rk").alias("h")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), row_key())
    hit = maybe_in(rows, F.col("rk"), known).alias("r").join(lists.alias("l"), F.col("r.id").eqNullSafe(F.col("l.id")) & (F.col("r.rk") == F.col("l.rk")), "left")
    none = F.array().cast(LEAKS)
    hit = hit.select("row.*", F.coalesce("found", none).alias(out))
    return hit.unionByName(maybe_in(rows, F.col("rk"), known, False).select("row.*", none.alias(out)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, containment."""
    return with_matches(docs.select("doc_id", "text"), benchmark, threshold).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no test item, with their columns."""
    free = next(n for n in ("_" * k + "leaks" for k in range(1, len(docs.columns) + 2)) if n not in docs.columns)
    return with_matches(docs, benchmark, threshold, out=free).where(F.size(free) == 0).drop(free)
