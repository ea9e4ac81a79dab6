"""Best-fit packing of documents into bins of several permitted lengths (numbered operator 6).

The token ids of documents are cut into pieces of at most the longest permitted length; pieces are dealt by a hash over blocks of a bounded
number of rows, and each block is packed by itself, so no task holds more than a block. A block wastes at most its last few
bins, a share that doesn't grow with the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prefix_hashes, range_hashes, slices, text_chunks, tokens

CAPACITIES = (512, 1024, 2048, 4096)
#: Ids that `hashed_words` gives to words.
VOCABULARY = 1 << 16
SCHEMA = "doc_id long, piece int, start long, length int, bin_id long, bin_offset int, capacity int, ids array<int>"


def bin_cost(capacity: int, overhead: float, attention: float) -> float:
    """Cost of a bin of `capacity` tokens: a fixed overhead, a linear part, and attention's quadratic part."""
    return overhead + capacity * (1.0 + attention * capacity)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = 64.0, attention: float = 1e-5) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) for pieces given longest first.

    Best fit: a piece goes to the open bin with the least room that holds it (ties: the bin opened first). If none does, a
    bin opens at the permitted size whose cost per token, for the tokens still to come, is least (ties: the smaller size).
    At the end each bin shrinks to the smallest permitted size that holds its contents. The permitted sizes are optimised
    jointly: this runs once for each largest size that may be opened, and the cheapest plan of all is kept.
    """
    best: tuple[float, list[int], list[int]] | None = None
    caps = sorted(capacities)
    for most in range(len(caps)):
        if lengths and caps[most] < lengths[0]:
            continue
        rest, rooms, bins, used, size = sum(lengths), [], [], [], []
        for n in lengths:
            k = bisect_left(rooms, (n, -1))
            if k < len(rooms):
                room, b = rooms.pop(k)
            else:
                fits = [c for c in caps[: most + 1] if c >= n]
                room = min(fits, key=lambda c: (bin_cost(c, overhead, attention) / min(c, max(rest, 1)), c))
                b = len(used)
                used.append(0)
                size.append(room)
            used[b] += n
            bins.append(b)
            rest -= n
            if room > n:
                insort(rooms, (room - n, b))
        size = [next(c for c in caps if c >= u) for u in used]
        cost = sum(bin_cost(c, overhead, attention) for c in size)
        if best is None or cost < best[0]:
            best = cost, bins, size
    return (best[1], best[2]) if best else ([], [])


def hashed_words() -> Callable[[pa.RecordBatch, int], pa.Array]:
    """A tokenizer for packing without a vocabulary: each word's id is 2 plus its hash in VOCABULARY buckets; id 1 ends a text."""

    def encode(b: pa.RecordBatch, column: int) -> pa.Array:
        ids, sizes = [], []
        for first, end, data, offsets in text_chunks(b.column(column)):
            starts, ends, doc = tokens(data, offsets)
            h = (range_hashes(prefix_hashes(data), starts, ends) % np.uint64(VOCABULARY)).astype(np.int32) + 2
            count = np.bincount(doc, minlength=end - first) + 1
            out = np.ones(count.sum(), np.int32)
            out[np.arange(len(h)) + doc] = h
            ids.append(out)
            sizes.append(count)
        offsets = np.r_[0, np.cumsum(np.concatenate(sizes) if sizes else [])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

    return encode


def best_fit_packing(
    docs: DataFrame, encode: Callable[[pa.RecordBatch, int], pa.Array] | None = None, capacities: Sequence[int] = CAPACITIES,
    block_rows: int = 4096, overhead: float = 64.0, attention: float = 1e-5,
) -> DataFrame:
    """Packs the token ids of every document of docs (doc_id, text, ...) into bins; see `pack` for the rule.

    Returns a row for each piece: doc_id, piece (from 0), start (first token of the piece in its document), length, bin_id,
    bin_offset (its first token in the bin), capacity of the bin, and ids, the piece's token ids: a bin's sequence is its
    pieces' ids by bin_offset, padded to the capacity.

    encode: from an Arrow batch and the place of its text column to a list of token ids for each row, `hashed_words` by
    default; an empty list counts as the one id 1. A document of null or empty text has the one token that ends it. A document
    longer than the largest capacity is cut there; all its tokens are packed. Repeated rows and repeated or null doc_ids are
    packed as often as they occur. Ties in length go by doc_id (null first), then piece. An empty table gives an empty result.
    Other columns don't matter.
    """
    most, caps, encode = max(capacities), tuple(capacities), encode or hashed_words()
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = encode(b, 1)
            values, edges = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(edges)
            pieces = np.maximum(1, -(-size // most))
            at = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.clip(size[at] - piece * most, 0, most)
            if (length == 0).any():  # an empty list
                values = np.insert(values, (edges[at] + piece * most)[length == 0], 1)
                length = np.maximum(length, 1)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(values.astype(np.int32)))
            columns = [b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(piece * most), pa.array(length.astype(np.int32)), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "start", "length", "ids"])

    pieces = materialise(numbered.mapInArrow(cut, "doc_id long, row long, piece int, start long, length int, ids array<int>"), "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))

    def pack_block(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks()
        bins, size = pack(rows["length"].to_pylist(), caps, overhead, attention)
        used, offset = [0] * len(size), []
        for b, n in zip(bins, rows["length"].to_pylist()):
            offset.append(used[b])
            used[b] += n
        first = rows["block"][0].as_py() << 32
        placed = [pa.array([first + b for b in bins], pa.int64()), pa.array(offset, pa.int32()), pa.array([size[b] for b in bins], pa.int32())]
        return pa.table([*(rows[c] for c in ("doc_id", "piece", "start", "length")), *placed, rows["ids"]], names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity", "ids"])

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack_block, SCHEMA)
