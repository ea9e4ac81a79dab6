"""Periodic runs of words by a dictionary of basic factors (numbered operator 13).

A basic factor is a stretch of 2**k words; equal ones of a document share a name, made of the names of its halves. In a run of
smallest period q, with 2**(k-1) < q <= 2**k, the next occurrence of the factor of 2**k words at i is the one at i+q, as long as
it fits: the occurrences form arithmetic progressions of difference q. Neighbouring places with one and the same distance to their
next occurrence propose period q for the stretch that they cover.

A run of four periods holds each factor that is no longer than its period three times or more. So places whose factor stands in the
document less often are left out of all longer factors: on text that repeats little next to nothing stays after two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, text_chunks, tokens

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words; equal words, and no others, have equal numbers."""
    inside = WORDS[data] != 0
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _ahead(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of each of some ascending places to the next one of its name (0: none)."""
    order = np.argsort(names, kind="stable")
    out = np.zeros(len(at), np.int64)
    out[order[:-1]] = np.where(names[order[1:]] == names[order[:-1]], at[order[1:]] - at[order[:-1]], 0)
    return out


def find_runs(names: np.ndarray, doc: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Maximal runs in documents given one after another, by word names and index of the document: rows (first word, length,
    smallest period) with length >= max(least, times * period), by first word, then period. times must be 3 at least."""
    out: list[np.ndarray] = []
    at, size = np.arange(len(names)), 1
    # A document's words are told apart from the next one's by the document's index.
    name = doc * (int(names.max()) + 1 if len(names) else 1) + names
    while len(at):
        ahead = _ahead(name, at)
        near = (ahead > size // 2) & (ahead <= size)
        if near.any():
            # Stretches of successive places with one distance.
            edge = np.ones(len(at), bool)
            edge[1:] = (np.diff(at) != 1) | (ahead[1:] != ahead[:-1])
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(at)) - 1
            q = ahead[first]
            length = at[last] - at[first] + size + q
            good = near[first] & (length >= np.maximum(least, times * q))
            out.append(np.stack([at[first], length, q], 1)[good])
        # Longer factors tell periods over `size`, of which a run holds each shorter factor times - 1 times at least.
        _, name, often = np.unique(name, return_inverse=True, return_counts=True)
        stay = often[name] >= times - 1
        at, name = at[stay], name[stay]
        half = np.searchsorted(at, at + size)
        whole = np.flatnonzero(half < len(at))
        whole = whole[at[half[whole]] == at[whole] + size]
        whole = whole[doc[at[half[whole]]] == doc[at[whole]]]
        name = np.unique(name[whole] * (int(name.max()) + 1 if len(name) else 1) + name[half[whole]], return_inverse=True)[1]
        at, size = at[whole], 2 * size
    runs = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    runs = np.unique(runs, axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run after the run's first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _collapse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
    """Per document its runs, with word numbers of its own, and its kept words joined by blanks."""
    starts, ends, doc = tokens(data, offsets)
    runs = find_runs(word_names(data, starts, ends), doc) if len(starts) else np.empty((0, 3), np.int64)
    drop = dropped_words(len(starts), runs)
    starts, ends, kept_doc = starts[~drop], ends[~drop], doc[~drop]
    # Keep the bytes of kept words, and the one after each of them but a document's last, as a blank.
    step = np.zeros(len(data) + 2, np.int8)
    step[starts] += 1
    step[ends] -= 1
    keep = np.cumsum(step[: len(data) + 1], dtype=np.int8) > 0
    inner = ends[:-1][kept_doc[1:] == kept_doc[:-1]]
    keep[inner] = True
    out = np.append(data, np.uint8(32))
    out[inner] = 32
    before = np.concatenate([[0], np.cumsum(keep)])
    text = out[keep].tobytes()
    first_word = np.searchsorted(doc, np.arange(len(offsets)))
    run_at = np.searchsorted(runs[:, 0], first_word)
    for k in range(len(offsets) - 1):
        own = runs[run_at[k] : run_at[k + 1]]
        yield own - [first_word[k], 0, 0], text[before[offsets[k]] : before[offsets[k + 1]]]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, runs array<struct<start, length, period>> (words numbered from 0; by start, then period),
    collapsed string: the words but those in a run after its first period, joined by blanks.

    A run is a stretch of words with smallest period q and at least max(6, 4*q) words that no neighbouring word extends. Null, empty
    and blank texts have no runs and an empty string; null doc_ids and repeated rows are kept as they are; other columns are ignored,
    an empty table gives no rows. No shuffle. A worker holds about 1 MB of text, or one longer text, in numpy form.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                flat, sizes, texts = [], [0], []
                for runs, text in _collapse(data, offsets):
                    flat.append(runs)
                    sizes.append(sizes[-1] + len(runs))
                    texts.append(text)
                rows = np.concatenate(flat)
                items = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(RUNS.value_type))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
