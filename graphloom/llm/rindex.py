"""Exact removal of long repeats by a run-length index (numbered operator 2).

A 200-byte string is anchored at the 32-byte substring with the least hash in it (the leftmost, if several). Equal strings
have equal anchors at equal places, so all places of a string meet under its anchor's hash. Successive strings of a document
that share an anchor form one snippet; equal snippets are one with a count. For anchors that have several different snippets,
a run-compressed Burrows-Wheeler transform of the snippets' suffixes is built: only at the ends of its runs are the longest
common prefixes with the neighbours computed; from there matching statistics stream through each snippet, falling by one a
byte until the next sampled run end. A start whose statistic reaches 200 bytes is a repeat, and so is every start of a snippet that has copies, whatever its group.

Anchors with very many snippets are narrowed down first. Each snippet is compared with one of its group, the pivot; strings
within what the two share are repeats. Any other string holds the first byte to the left, or to the right, at which its
snippet leaves the pivot; two equal ones leave it at the same place with the same byte, so the hash of what lies between that
byte and the anchor deals them to smaller groups. A string that holds both such bytes goes by the left one alone: each place
of a string is in one group at most, and never meets itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_cells, materialise, maybe_in, mix, prefix_hashes, range_hashes, row_key, text_chunks

ANCHOR = 32
#: Different snippets that one group may hold before it is split by more context.
GROUP = 1024
#: Suffixes that a task indexes at once.
BATCH = 60_000
#: Bytes of a long text whose anchors are computed at once.
PIECE = 4 << 20


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value (by its top 40 bits) in each window of `width` values; len(h) <= 2**24."""
    n = len(h)
    packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = packed
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def snippets(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor: (anchor hash, snippet hash, document, first start in it, number of starts,
    anchor's place after the first start)."""
    parts = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        if len(piece) < length:
            break
        prefix = prefix_hashes(piece)
        first = np.arange(len(piece) - ANCHOR + 1)
        h = range_hashes(prefix, first, first + ANCHOR)
        anchor = sliding_argmin(h, length - ANCHOR + 1)
        start = np.arange(len(anchor))
        doc = np.searchsorted(offsets, at + start, side="right") - 1
        fits = at + start + length <= offsets[doc + 1]
        start, anchor, doc = start[fits], anchor[fits], doc[fits]
        if len(start):
            cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            count = np.diff(np.append(cut, len(start)))
            lo = start[cut]
            sh = mix(range_hashes(prefix, lo, lo + count - 1 + length) + np.uint64(1))
            parts.append((h[anchor[cut]], sh, doc[cut], at + lo - offsets[doc[cut]], count, anchor[cut] - lo))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """docs (rk, text) -> ah, sh, rk, lo, count, off: a row for each snippet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for first, end, data, offsets in text_chunks(b.column(1)):
                ah, sh, doc, lo, count, off = snippets(data, offsets, length)
                rk = keys[first:end][doc]
                yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(rk), pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32))], names=["ah", "sh", "rk", "lo", "count", "off"])

    return docs.mapInArrow(run, "ah long, sh long, rk long, lo int, count int, off int")


# ---------------------------------------------------------------------------------------------------------------------
# The index


def matching_statistics(texts: list[bytes], counts: list[int]) -> np.ndarray:
    """For the first counts[i] suffixes of every text, one after the other: the longest prefix shared with another of these
    suffixes, as far as a run-compressed Burrows-Wheeler transform tells.

    Suffixes are sorted; the transform is the byte before each (none for a text's first). Where a suffix and both neighbours
    lie within one run of equal bytes, its longest common prefix is one less than that of the suffix a byte before it, which
    has the same neighbours moved by a byte. So prefixes are compared at run ends only.
    """
    width = max(map(len, texts))
    flat = np.zeros(sum(counts) + sum(map(len, texts)) + width, np.uint8)
    begin, at, offset_in = [], 0, []
    for t, n in zip(texts, counts):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8) + 1  # UTF-8 has no byte 255; 0 ends a text
        begin.append(at + np.arange(n))
        offset_in.append(np.arange(n))
        at += len(t) + 1
    begin, offset_in = np.concatenate(begin), np.concatenate(offset_in)
    span = np.repeat([len(t) for t in texts], counts) - offset_in
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[begin]
    rows[np.arange(width)[None, :] >= span[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    before = np.where(offset_in == 0, np.int16(-1), flat[np.maximum(begin - 1, 0)].astype(np.int16))[order]
    run_end = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0), True]  # a run ends before, and after, each place
    sampled = np.flatnonzero(run_end[:-1] | run_end[1:])
    best = np.zeros(len(sampled), np.int64)
    for step in (-1, 1):
        other = sampled + step
        ok = (other >= 0) & (other < len(order))
        a, b = order[sampled[ok]], order[other[ok]]
        differs = rows[a] != rows[b]
        common = np.where(differs.any(1), differs.argmax(1), width)
        best[ok] = np.maximum(best[ok], np.minimum(common, np.minimum(span[a], span[b])))
    known = np.full(len(order), -1, np.int64)
    known[order[sampled]] = best
    last = np.maximum.accumulate(np.where(known >= 0, np.arange(len(known)), -1))
    return known[last] - (np.arange(len(known)) - last)


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, ah, sh, s0, c, bytes) by key -> ah, sh, from, to: repeated starts of snippets. Groups stay whole."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        counts = [len(r[5]) - length + 1 for r in rows]
        reach = matching_statistics([r[5] for r in rows], counts) >= length
        out, at = [], 0
        for (_, ah, sh, s0, c, _), n in zip(rows, counts):
            hit = reach[at : at + n]
            at += n
            if c > 1:  # marked as a whole already
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            out += [(ah, sh, s0 + int(a), s0 + int(b)) for a, b in zip(edge[::2], edge[1::2])]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["ah", "sh", "from", "to"])

    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][0] != row[0]:
                if size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
            held.append(row)
            size += len(row[5]) - length + 1
    if held:
        yield flush(held)


def _leave_pivot(batches: Iterator[pa.RecordBatch], length: int, ends: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, ah, sh, s0, o1, o2, off, c, bytes, pivot: the same without key) -> with `ends`, the repeats that rows and
    pivots share (ah, sh, from, to); else the rows that go on, in new groups. The anchor lies `off` behind the first byte; only
    strings whose anchor lies o1 to o2 behind their start count."""
    room = length - ANCHOR
    for b in batches:
        out, shared = [], set()
        for _, ah, sh, s0, o1, o2, off, c, text, p in zip(*(x.to_pylist() for x in b.columns)):
            if (ah, sh, s0) == (p["ah"], p["sh"], p["s0"]):
                continue
            left, right, other, p_off = text[:off][::-1], text[off + ANCHOR :], p["bytes"], p["off"]
            same = [next((k for k, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v))) for u, v in ((left, other[:p_off][::-1]), (right, other[p_off + ANCHOR :]))]
            if ends:
                low, high = max(o1, room - same[1]), min(o2, same[0])  # anchor offsets of the strings that both hold
                if low <= high:
                    out.append((ah, sh, s0 + off - high, s0 + off - low + 1))
                    shared.add((p["ah"], p["sh"], p["s0"] + p_off - high, p["s0"] + p_off - low + 1))
                continue
            for side, low, high, around in ((1, max(o1, same[0] + 1), o2, text[off - same[0] - 1 : off + ANCHOR] if same[0] < off else None), (2, o1, min(o2, same[0], room - same[1] - 1), text[off : off + ANCHOR + same[1] + 1] if same[1] < len(right) else None)):
                a, z = max(0, off - high), min(len(text) - length, off - low)
                if around is not None and low <= high and a <= z:
                    digest = hashlib.blake2b(around + bytes([side]) + same[side - 1].to_bytes(4, "little"), digest_size=8).digest()
                    out.append((int.from_bytes(digest, "little", signed=True), ah, sh, s0 + a, low, high, off - a, c, text[a : z + length]))
        if ends:
            names, kinds = ["ah", "sh", "from", "to"], [pa.int64()] * 2 + [pa.int32()] * 2
            out += sorted(shared)
        else:
            names, kinds = ["key", "ah", "sh", "s0", "o1", "o2", "off", "c", "bytes"], [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)


def _cut_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted snippets (rk, ah, sh, lo, count, off, c), from docs (rk, text): ah, sh, off, c, bytes."""
    lists = wanted.groupBy("rk").agg(F.collect_list(F.struct("ah", "sh", "lo", "count", "off", "c")).alias("all"))
    known = filter_cells(lists.select(F.col("rk").alias("h")))
    texts = maybe_in(docs, F.col("rk"), known).join(lists, "rk").select("text", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw, rows = b.column(0)[k].as_py().encode(), b.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in (("ah", pa.int64()), ("sh", pa.int64()), ("off", pa.int32()), ("c", pa.int64()))] + [pa.array([raw[r["lo"] : r["lo"] + r["count"] - 1 + length] for r in rows], pa.binary())], names=["ah", "sh", "off", "c", "bytes"])

    return texts.mapInArrow(run, "ah long, sh long, off int, c long, bytes binary").dropDuplicates(["ah", "sh"])


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (rk, text) -> rk, spans: array of (start, end) byte ranges, possibly overlapping, of all strings of `length` bytes
    that start anywhere else too."""
    found = occurrences(docs, length)
    often = found.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah")
    found = materialise(found.join(often, "ah"), "repeats")
    copies = found.groupBy("ah", "sh").agg(F.count("*").alias("c"), F.min(F.struct("rk", "lo", "count", "off")).alias("one"))
    copies = materialise(copies.select("ah", "sh", "c", "one.*"), "copies")
    kinds = copies.groupBy("ah").agg(F.count("*").alias("kinds"))
    copies = materialise(copies.join(kinds, "ah"), "kinds")
    again = copies.where("c > 1").select("ah", "sh", F.lit(0).alias("from"), F.col("count").alias("to"))
    rows = _cut_bytes(docs, copies.where("kinds > 1"), length)
    rows = rows.select(F.col("ah").alias("key"), "ah", "sh", F.lit(0).alias("s0"), F.lit(0).alias("o1"), F.lit(length - ANCHOR).alias("o2"), "off", "c", "bytes")
    marks = [again]
    rows = materialise(rows, "snippets")
    schema = rows.schema
    while True:
        groups = rows.groupBy("key").agg(F.count("*").alias("rows"))
        state = groups.agg(F.max("rows")).head()[0]
        if state is None:
            break
        dealt = rows.join(groups.where((F.col("rows") <= GROUP) & (F.col("rows") > 1)).select("key"), "key")
        dealt = dealt.select("key", "ah", "sh", "s0", "c", "bytes").repartition("key").sortWithinPartitions("key")
        marks.append(materialise(dealt.mapInArrow(lambda b: _index(b, length), "ah long, sh long, from int, to int"), "marks"))
        if state <= GROUP:
            break
        large = rows.join(groups.where(F.col("rows") > GROUP).select("key"), "key")
        pivot = large.groupBy("key").agg(F.min(F.struct("sh", "ah", "s0", "off", "bytes")).alias("pivot"))
        large = materialise(large.select(*schema.names).join(pivot, "key"), "pivots")
        marks.append(materialise(large.mapInArrow(lambda b: _leave_pivot(b, length, True), "ah long, sh long, from int, to int"), "marks"))
        rows = materialise(large.mapInArrow(lambda b: _leave_pivot(b, length, False), schema), "rest")
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    hits = found.select("ah", "sh", "rk", "lo").join(every, ["ah", "sh"])
    return hits.groupBy("rk").agg(F.collect_set(F.struct((F.col("lo") + F.col("from")).alias("start"), (F.col("lo") + F.col("to") - 1 + length).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept: a row for each row of docs.

    Each byte goes that is covered by a string of `length` bytes which also starts anywhere else in the table, the same
    document included; overlaps count, and strings are judged on the input. Strings don't cross documents. n_spans counts
    maximal removed runs; kept holds the remaining bytes (binary: a cut may part a character). Null text counts as empty.
    Repeated rows are copies of each other, and so go wholly if they are long enough. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", row_key(), "text")
    spans = materialise(repeated_spans(rows.where(F.octet_length("text") >= length).select("rk", "text"), length), "spans")
    known = filter_cells(spans.select(F.col("rk").alias("h")))
    hit = maybe_in(rows, F.col("rk"), known).join(spans, "rk", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                raw, runs = b.column(1)[k].as_py().encode(), []
                for s in sorted((x["start"], x["end"]) for x in b.column(2)[k].as_py()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(runs), kept))
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.binary(),)))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    changed = hit.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    same = maybe_in(rows, F.col("rk"), known, False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(same)
