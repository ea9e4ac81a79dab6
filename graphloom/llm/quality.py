"""Quality classifier by importance resampling (numbered operator 1).

Two generative models over hashed n-grams, one of labelled good text and one of all text, give each document an importance
weight: the log of the ratio of its likelihoods. Gumbel noise on the log weights and a cut at the k-th largest make a sample
without replacement in proportion to the weights.

A plain sum of log ratios is ruled by length: long good texts spread over hundreds of log units, where noise decides nothing. So
the sum is tempered: the weight is that of a stretch of `SCALE` n-grams, about a sentence, with the document's mean, drawn towards
0 by `PRIOR` n-grams of ratio one. Good and bad texts then lie a few units of noise apart, and those between are sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, byte_classes, materialise, prefix_hashes, range_hashes, shingle_hashes, slices, text_chunks, tokens

BITS = 16
SCALE, PRIOR = 30.0, 25.0
#: 0 white space, 1 ASCII punctuation, 2 letters, digits and all bytes of longer UTF-8 sequences.
KINDS = byte_classes(space=SPACE, punctuation=bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of all documents, and the document of each. Runs of letters and runs of
    punctuation are tokens."""
    starts, ends, doc = tokens(data, offsets, KINDS)
    h = range_hashes(prefix_hashes(data), starts, ends)
    pairs, at = shingle_hashes(h, doc, 2)
    shift = np.uint64(64 - bits)
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), np.concatenate([doc, doc[at]])


@dataclass(frozen=True)
class QualityModel:
    """log_ratio: of a bucket's probability in target text to that in all text. cut: log weight that parts good from bad."""

    log_ratio: np.ndarray
    cut: float

    def log_weights(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, end, data, offsets in text_chunks(column):
            bucket, doc = features(data, offsets)
            total, n = np.bincount(doc, self.log_ratio[bucket], minlength=end - first), np.bincount(doc, minlength=end - first)
            out[first:end] = SCALE * total / (n + PRIOR)
        return out


def with_log_weight(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "log_weight") -> DataFrame:
    """docs with a double column `out`: the log importance weight of each row (0 for null or empty text)."""
    position = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.log_weights(b.column(position)))], names=[*b.schema.names, out])

    return docs.mapInArrow(score, docs.drop(out).schema.add(out, "double"))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, smoothing: float = 1.0) -> QualityModel:
    """Fits on docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    The model of all text counts every document. The target model and the cut come from at most `max_labels` labelled
    documents, those with the least hash of doc_id: half of them train the target model (quality 1), the other half set the
    cut (see `best_cut`). Documents whose labels disagree don't count. Without
    labels of both kinds the cut is minus infinity, so everything is kept.
    """
    few = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most").orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
        .select("label_id", "quality", (F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(2)) == 0).alias("trains"))
    )
    few = materialise(few.coalesce(1), "labels")  # at most max_labels rows: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for b in batches:
            target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_chunks(b.column(0)):
                bucket, doc = features(data, offsets)
                total[0] += np.bincount(bucket, minlength=size)
                total[1] += np.bincount(bucket[target[first:end][doc]], minlength=size)
        model, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[model, bucket])], names=["model", "bucket", "n"])

    marked = texts.join(F.broadcast(few), texts.doc_id == few.label_id, "left").select("text", F.coalesce(F.expr("trains and quality = 1"), F.lit(False)).alias("target"))
    counts = np.zeros((2, size))
    found = marked.mapInArrow(count, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 2 * size rows at most
    counts[found["model"], found["bucket"]] = found["n"]
    if not counts[1].any():
        return QualityModel(np.zeros(size), -np.inf)
    p = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * size)
    model = QualityModel(p[1] - p[0], -np.inf)
    judged = with_log_weight(texts.join(F.broadcast(few.where("not trains")), texts.doc_id == few.label_id).select("quality", "text"), model).select("quality", "log_weight").toPandas()
    return QualityModel(model.log_ratio, best_cut(judged["log_weight"].to_numpy(), judged["quality"].to_numpy()))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the most bad texts below it, less five times the good ones (as shares of all bad and all good);
    in the middle of the gap that it lies in."""
    if not (good == 1).any() or not (good == 0).any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order] == 1
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    value = caught - 5 * lost
    value[1:-1][w[1:] == w[:-1]] = -1
    k = int(np.argmax(value))
    return float(w[0] - 1 if k == 0 else w[-1] + 1 if k == len(w) else (w[k - 1] + w[k]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, cells: int = 4096) -> float:
    """The k-th largest of a column of finite doubles, exactly: histograms narrow the range down, so little is collected."""
    low, high = df.agg(F.min(column), F.max(column)).head()
    while True:
        width = (high - low) / cells
        if width <= 0 or low + width == low:
            return high
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(cells - 1))
        found = {r.cell: (r.n, r.a, r.b) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for c in sorted(found, reverse=True):
            n, a, b = found[c]
            if n >= k:
                break
            k -= n
        if a == b or k == n:
            return a
        if k == 1:
            return b
        low, high = a, b


def gumbel(seed: int, *ids: Column) -> Column:
    """Gumbel noise that depends on the ids and the seed alone."""
    u = (F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 1, max_labels: int = 20_000) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that a Gumbel top-k sample by importance weight takes, with all their columns.

    Added columns: log_weight and sample_key (log_weight / temperature + Gumbel noise); columns of docs that have these
    names are replaced. k defaults to the number of documents whose weight is over the cut learnt from the labels (see
    `fit`), so the sample is as large as the good part of the corpus.

    A null or empty text has weight 0. Rows of one doc_id get the same noise, so repeated rows stay or go together; rows
    that tie at the k-th key all stay. Without usable labels, and for an empty table, all rows stay.
    """
    model = fit(docs, labels, max_labels)
    scored = with_log_weight(docs.drop("log_weight", "sample_key"), model).withColumn("sample_key", F.col("log_weight") / temperature + gumbel(seed, F.col("doc_id").cast("long")))
    keys = materialise(scored.select("log_weight", "sample_key"), "keys")
    n, over = keys.agg(F.count("*"), F.count(F.when(F.col("log_weight") >= model.cut, 1))).head()
    k = over if k is None else k
    if k >= n:
        return scored
    return scored.where(F.col("sample_key") >= kth_largest(keys, "sample_key", k)) if k > 0 else scored.limit(0)
