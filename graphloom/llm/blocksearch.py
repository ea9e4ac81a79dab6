"""Ranked lexical search with geometrically blocked posting lists (numbered operator 12).

A document is a sparse vector of impacts over terms, an item a vector of term weights, and the score their inner product. Documents
are dealt over shards. In a shard each posting list is clustered by the similarity of its documents and cut to blocks; a block keeps
the coordinatewise maximum of its documents' vectors. The product of an item with that summary is no less than any score in the
block, so a block is skipped only when this bound is below the score that the item's tenth place is sure to reach.

Two more bounds of the same kind save work. A first pass scores the documents of each item's rarest terms, whose tenth best score is
a floor of the final one. And a list counts as a block with the term's largest impact for a summary: the terms whose bounds add up to
less than the floor can't carry a document alone, so only lists of the other terms are blocked and searched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, byte_classes, materialise, text_chunks, tokens

#: 0 ASCII but letters and digits, 1 all else.
TERMS = byte_classes(other=bytes(c for c in range(128) if not chr(c).isalnum()))
#: Items are searched in blocks of about so many bytes of distinct texts; each block reads the corpus once.
ITEM_BYTES = 4 << 20
#: A shard ends with the document that brings it to so many postings.
SHARD_POSTINGS = 1_000_000
#: Documents of a block; more where the summaries of a list would take over so many numbers.
BLOCK, SUMMARY_CELLS = 4, 4_000_000
#: The first pass takes an item's rarest terms until they stand in so many documents.
SEED_DOCS = 200
FORWARD = "doc_id long, n long, terms array<int>, tf array<int>"


# ---------------------------------------------------------------------------------------------------------------------
# Terms


def term_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the terms, A-Z in lower case."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    inside = LOWER[data[TERMS[data] != 0]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of a text, sorted."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = tokens(data, np.array([0, len(data)]), TERMS)
    return sorted(set(term_column(data, starts, ends).to_pylist())) if len(starts) else []


def encode(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary (as places in it, ascending) with their counts."""
    known = pa.array(vocabulary, pa.large_binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                starts, ends, doc = tokens(data, offsets, TERMS)
                n = np.bincount(doc, minlength=end - first)
                at = pc.index_in(term_column(data, starts, ends), value_set=known) if len(starts) else pa.array([], pa.int32())
                own = at.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(doc[own] * len(vocabulary) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(end - first + 1) * len(vocabulary)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (key % max(1, len(vocabulary)), tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, FORWARD)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 90 + (90 * n * n_docs) // n_terms


# ---------------------------------------------------------------------------------------------------------------------
# A shard


@dataclass
class Shard:
    """Documents as rows of (term, impact), row after row."""

    doc_id: pa.Array
    cuts: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some rows, and where each row's begin among them."""
        size = self.cuts[rows + 1] - self.cuts[rows]
        begin = np.cumsum(size) - size
        return np.repeat(self.cuts[rows] - begin, size) + np.arange(int(size.sum())), begin

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of rows (each with a term at least); weight: of every term of the vocabulary."""
        at, begin = self.entries(rows)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], begin)

    def postings(self, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Terms in ascending order, and the row of each; a term's rows by rank, if one is given."""
        row = self.row
        order = np.argsort(self.term, kind="stable") if rank is None else np.lexsort((rank[row], self.term))
        return self.term[order], row[order]


def shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Shard]:
    """Shards of a task's documents; documents without a term of the vocabulary can't score and are left out."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        width = np.diff(b.column(2).offsets.to_numpy())
        reach = np.cumsum(width)
        first = 0
        while first < b.num_rows:
            room = SHARD_POSTINGS - size + (reach[first - 1] if first else 0)
            end = min(b.num_rows, int(np.searchsorted(reach, room)) + 1)
            part = b.slice(first, end - first)
            keep = np.flatnonzero(width[first:end])
            n = part.column(1).to_numpy()
            term, tf = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            own = width[first:end]
            held.append((part.column(0).take(pa.array(keep)), own[keep], term, (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(length_norm(n, n_docs, n_terms), own))))
            size += len(term)
            first = end
            if size >= SHARD_POSTINGS:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held: list[tuple]) -> Shard:
    width = np.concatenate([h[1] for h in held])
    return Shard(pa.concat_arrays([h[0] for h in held]), np.concatenate([[0], np.cumsum(width)]).astype(np.int64), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))


def sketches(shard: Shard, weight: np.ndarray, dims: int = 12) -> np.ndarray:
    """Random projections of the rows' weighted vectors: near rows have near sketches."""
    sign = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (len(weight), dims))
    value = (weight[shard.term] * shard.impact).astype(np.float32)
    return np.stack([np.add.reduceat(value * sign[shard.term, k], shard.cuts[:-1]) for k in range(dims)], 1)


def similarity_ranks(sketch: np.ndarray, size: int) -> np.ndarray:
    """Ranks of rows in an order in which near sketches stand together: groups are halved along the direction in which they differ
    most, down to `size`. The rows of any posting list, taken in this order, are clustered too."""
    todo, rank, at = [np.arange(len(sketch))], np.empty(len(sketch), np.int64), 0
    while todo:
        own = todo.pop()
        if len(own) <= size:
            rank[own] = np.arange(at, at + len(own))
            at += len(own)
            continue
        x = sketch[own]
        order = np.argpartition(x[:, int(np.argmax(x.var(0)))], len(own) // 2)
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return rank


class BlockedList:
    """A posting list of a shard, its rows in the order of their similarity: blocks of successive rows, and the coordinatewise maxima of
    their vectors, a line for each block."""

    def __init__(self, shard: Shard, rows: np.ndarray, terms: int):
        size = max(BLOCK, -(-len(rows) * terms // SUMMARY_CELLS))
        self.rows, self.block = rows, np.arange(len(rows)) // size
        self.summary = np.zeros((int(self.block[-1]) + 1, terms), np.int32)
        at, _ = shard.entries(rows)
        cell = np.repeat(self.block * terms, shard.cuts[rows + 1] - shard.cuts[rows]) + shard.term[at]
        np.maximum.at(self.summary.reshape(-1), cell, shard.impact[at].astype(np.int32))

    def passing(self, terms: np.ndarray, weight: np.ndarray, floor: int) -> np.ndarray:
        """Whether each block's bound, which no score in it exceeds, is `floor` or more."""
        return self.summary[:, terms].astype(np.int64) @ weight >= floor


# ---------------------------------------------------------------------------------------------------------------------
# Search


@dataclass
class Items:
    """A block of items: their terms as places in the vocabulary, and what is known of the terms."""

    keys: list[str]
    terms: list[np.ndarray]
    vocabulary: list[bytes]
    weight: np.ndarray
    df: np.ndarray
    most: np.ndarray

    def dense(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.vocabulary), np.int64)
        out[self.terms[k]] = self.weight[self.terms[k]]
        return out

    def rarest(self, k: int) -> np.ndarray:
        t = self.terms[k][self.df[self.terms[k]] > 0]
        t = t[np.argsort(self.df[t], kind="stable")]
        return t[: int(np.searchsorted(np.cumsum(self.df[t]), SEED_DOCS)) + 1]

    def needed(self, k: int, floor: int) -> np.ndarray:
        """Terms whose lists hold every document of `floor` or more, the strongest first."""
        t = self.terms[k]
        bound = self.weight[t] * self.most[t]
        order = np.argsort(bound, kind="stable")
        kept = order[np.cumsum(bound[order]) >= floor]
        return t[kept[::-1]]


def _best(rows: np.ndarray, score: np.ndarray, shard: Shard, limit: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the `limit` highest scores of `floor` or more, ties to the smaller doc_id (nulls first, as Spark sorts)."""
    good = np.flatnonzero(score >= floor)
    if len(good) > limit:
        good = good[score[good] >= np.partition(score[good], len(good) - limit)[len(good) - limit]]
    ids = pc.fill_null(shard.doc_id.take(pa.array(rows[good])), -(1 << 63)).to_numpy()
    good = good[np.lexsort((ids, -score[good]))][:limit]
    return rows[good], score[good]


def seed_scores(shard: Shard, items: Items, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    term, row = shard.postings()
    for k in range(len(items.keys)):
        lists = [row[np.searchsorted(term, t) : np.searchsorted(term, t, side="right")] for t in items.rarest(k)]
        rows = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
        if len(rows):
            yield k, *_best(rows, shard.scores(rows, items.dense(k)), shard, limit, 1)


def block_search(shard: Shard, items: Items, floors: np.ndarray, limit: int, count: Callable[[int, int], None] = lambda passed, skipped: None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per item its best rows in the shard, of `floors` or more. count: is told how many blocks of a list pass and are skipped.

    List by list, rarest first, for all items that need it; an item's floor rises with the tenth best score that it has met."""
    askers: dict[int, list[int]] = {}
    for k, floor in enumerate(floors.tolist()):
        for t in items.needed(k, floor).tolist():
            askers.setdefault(t, []).append(k)
    term, row = shard.postings(similarity_ranks(sketches(shard, items.weight), BLOCK))
    none = np.empty(0, np.int64)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    floors = floors.copy()
    weight = np.zeros(len(items.vocabulary), np.int64)
    for t in sorted(askers, key=lambda t: (items.df[t], t)):
        rows = row[np.searchsorted(term, t) : np.searchsorted(term, t, side="right")]
        if not len(rows):
            continue
        blocked = BlockedList(shard, rows, len(items.vocabulary))
        for k in askers[t]:
            own = items.terms[k]
            passed = blocked.passing(own, items.weight[own], floors[k])
            count(int(passed.sum()), int((~passed).sum()))
            if not passed.any():
                continue
            met, score = best.get(k, (none, none))
            new = np.setdiff1d(rows[passed[blocked.block]], met)
            if not len(new):
                continue
            weight[own] = items.weight[own]
            found = shard.scores(new, weight)
            weight[own] = 0
            met, score = best[k] = _best(np.concatenate([met, new]), np.concatenate([score, found]), shard, limit, int(floors[k]))
            if len(score) == limit:
                floors[k] = max(floors[k], score[-1])
    for k, (rows, score) in best.items():
        if len(rows):
            yield k, rows, score


def _per_shard(forward: DataFrame, items: Items, n_docs: int, n_terms: int, work: Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """What `work` finds in each shard, as item int, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, n_docs, n_terms):
            found = list(work(shard))
            if found:
                item = np.repeat([k for k, _, _ in found], [len(r) for _, r, _ in found])
                rows, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), shard.doc_id.take(pa.array(rows)), pa.array(score)], names=["item", "doc_id", "score"])

    return forward.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _search_block(docs: DataFrame, texts: list[str], limit: int) -> DataFrame | None:
    """item (place in texts), doc_id, score, rank of a block of texts."""
    own = [terms_of(t) for t in texts]
    vocabulary = sorted(set().union(*own))
    if not vocabulary:
        return None
    forward = materialise(encode(docs, vocabulary), "forward")
    n_docs, n_terms = forward.where("n > 0").agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return None
    place = {t: k for k, t in enumerate(vocabulary)}
    norm = F.lit(100 - 90) + F.expr(f"(90L * n * {n_docs}L) div {n_terms}L")
    entries = forward.select(norm.alias("m"), F.inline(F.arrays_zip("terms", "tf")))
    stats = entries.groupBy("terms").agg(F.count("*").alias("df"), F.max(F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).alias("most"))
    df, most, weight = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in stats.collect():  # a row for each term of the block of items
        df[r.terms], most[r.terms] = r.df, r.most
        weight[r.terms] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    items = Items([str(k) for k in range(len(texts))], [np.array([place[t] for t in x], np.int64) for x in own], vocabulary, weight, df, most)
    seeds = _ranked(_per_shard(forward, items, n_docs, n_terms, lambda s: seed_scores(s, items, limit)), limit)
    floors = np.ones(len(texts), np.int64)
    for r in seeds.where(F.col("rank") == limit).collect():  # a row for each item of the block at most
        floors[r.item] = max(1, r.score)
    return _ranked(_per_shard(forward, items, n_docs, n_terms, lambda s: block_search(s, items, floors, limit)), limit)


def search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank int, doc_id, score long: each item's `limit` documents of the
    highest score above 0, by score, then doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A term's weight is
    floor(1000 * ln((2N+2) / (2df+1))), a document's impact for it 10^9 tf div (1000 tf + 8m), m = 10 + 90nN div L; all in 64 bits.
    Null and empty texts have no terms: such documents are never found, such items find nothing. Every row of docs is a document,
    so repeated rows are found side by side; null doc_ids come first among ties; every row of items gets its own results. Other
    columns are ignored.

    The corpus is tokenised once for each block of items (about 4 MB of distinct item texts, which with their terms are all that
    the driver holds) and its vectors, restricted to the block's terms, are written once; no text is shuffled. Tasks cut their
    documents to shards of a bounded number of postings; a shard gives up to `limit` rows for each item, of scores that reach
    the item's floor.
    """
    spark = docs.sparkSession
    texts = items.where(F.length("text") > 0).select("text").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, blocks))))
    out = None
    for b in range(blocks):
        own = sorted(r.text for r in numbered.where(F.col("block") == b).collect())  # ITEM_BYTES, or one longer text, on average
        found = _search_block(docs, own, limit)
        if found is None:
            continue
        names = spark.createDataFrame(list(enumerate(own)), "item int, text string")
        part = found.join(names, "item").select("text", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "text string, rank int, doc_id long, score long")
    return items.select("item_id", "text").join(out, "text").select("item_id", "rank", "doc_id", "score")
