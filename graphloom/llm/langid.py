"""Language identification as mixture inference (numbered operator 4).

A document is a mixture of languages: each of its character n-grams comes from one of the learnt distributions, in unknown
proportions. Expectation-maximisation estimates the proportions; a penalised likelihood decides how many languages count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

BITS = 13
#: Letters (lower case in A-Z) and bytes of longer UTF-8 sequences stay; all else is a blank.
_NORMAL = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams around each byte of a word, and their documents. Blanks pad words and texts."""
    if not len(data):
        return (np.empty(0, np.int64),) * 2
    x = _NORMAL[data]
    accented = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
    x[accented] += 32  # Latin-1's capital letters
    left, right = np.empty_like(x), np.empty_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    left[full] = 32
    right[offsets[1:][np.diff(offsets) > 0] - 1] = 32
    at = np.flatnonzero(x != 32)
    code = (left[at].astype(np.uint32) << np.uint32(16)) | (x[at].astype(np.uint32) << np.uint32(8)) | right[at]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return bucket.astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


@dataclass(frozen=True)
class LanguageModel:
    """probability: buckets x languages. penalty: of each further language, times the log of the number of n-grams. EM ends
    when no proportion of a document moves by more than `tolerance` in a round."""

    languages: tuple[str, ...]
    probability: np.ndarray
    penalty: float = 8.0
    tolerance: float = 1e-3

    def proportions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents x languages: proportions of the chosen languages, 0 for others; all 0 without n-grams."""
        docs, size = len(offsets) - 1, len(self.probability)
        bucket, doc = ngram_buckets(data, offsets)
        out = np.zeros((docs, len(self.languages)))
        step = max(1, (1 << 21) // size)
        for first in range(0, docs, step):
            end = min(docs, first + step)
            a, b = np.searchsorted(doc, [first, end])
            if a == b:
                continue
            table = np.bincount((doc[a:b] - first) * size + bucket[a:b], minlength=(end - first) * size)
            cell = np.flatnonzero(table)
            count, own = table[cell].astype(float), cell // size
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[cut] + first] = self._mixtures(self.probability[cell % size], count, np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(own)))), cut)
        return out

    def _em(self, p: np.ndarray, count: np.ndarray, doc: np.ndarray, cut: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihoods of all documents, from the proportions to start with. Documents that have settled
        drop out of further rounds."""
        n = len(cut)
        share, like = share.copy(), np.empty(n)
        if share.shape[1] == 1:
            return share, np.add.reduceat(count * np.log(p[:, 0]), cut)
        moving = np.arange(n)
        while len(moving):
            before = share[moving]
            joint = p * before[doc]
            total = joint.sum(1)
            like[moving] = np.add.reduceat(count * np.log(total), cut)
            joint *= (count / total)[:, None]
            after = np.add.reduceat(joint, cut, axis=0)
            after /= after.sum(1, keepdims=True)
            share[moving] = after
            on = np.abs(after - before).max(1) > self.tolerance
            if not on.all():
                rows = on[doc]
                p, count, moving = p[rows], count[rows], moving[on]
                doc = (np.cumsum(on) - 1)[doc[rows]]
                cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        return share, like

    def _mixtures(self, p: np.ndarray, count: np.ndarray, doc: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The best number of languages, taken in the order of the proportions that all languages together get. Documents for
        which a further language doesn't pay are done."""
        n, many = len(cut), len(self.languages)
        share, _ = self._em(p, count, doc, cut, np.full((n, many), 1 / many))
        order = np.argsort(-share, axis=1, kind="stable")
        total = np.add.reduceat(count, cut)
        best, out = np.full(n, np.inf), np.zeros((n, many))
        open_ = np.arange(n)
        for k in range(1, many + 1):
            few = order[open_, :k]
            own = np.take_along_axis(p, few[doc], axis=1)
            start = np.take_along_axis(share[open_], few, axis=1) + 1e-3
            part, like = self._em(own, count, doc, cut, start / start.sum(1, keepdims=True))
            cost = -2 * like + self.penalty * k * np.log(total[open_] + 1)
            better = cost < best[open_]
            here = open_[better]
            best[here] = cost[better]
            out[here] = 0
            out[here[:, None], few[better]] = part[better]
            if not better.any():
                break
            if not better.all():
                rows = better[doc]
                p, count, open_ = p[rows], count[rows], here
                doc = (np.cumsum(better) - 1)[doc[rows]]
                cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        return out


def fit(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Counts n-grams of docs (text, lang) by language, over all rows whose lang isn't null."""
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    names = tuple(sorted(r.lang for r in known.select("lang").distinct().collect()))  # a row for each language
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * size, np.int64)
        place = {x: k for k, x in enumerate(names)}
        for b in batches:
            lang = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            for first, end, data, offsets in text_chunks(b.column(0)):
                bucket, doc = ngram_buckets(data, offsets)
                total += np.bincount(lang[first:end][doc] * size + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    table = np.zeros(len(names) * size)
    if names:
        found = known.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages times buckets at most
        table[found["cell"]] = found["n"]
    table = table.reshape(len(names), size).T + smoothing
    return LanguageModel(names, table / table.sum(0, keepdims=True) if names else table)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each row: doc_id, lang_pred, score, languages.

    lang_pred is the language with the largest proportion (ties: the first by name), score its proportion, languages all of
    the chosen set as `name:proportion`, largest first. Null text, and text without a letter, gives `und`, score 0 and an
    empty string, as does a model without languages. Only text is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, sets = [], [], []
            for first, end, data, offsets in text_chunks(b.column(1)):
                share = model.proportions(data, offsets) if model.languages else np.zeros((end - first, 1))
                top, ascii_letter = share.argmax(1), np.concatenate([[0], np.cumsum((_NORMAL[data] != 32) & (data < 128))])
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for k in range(end - first):
                    if share[k, top[k]] > 0 and (plain[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())):
                        some = [j for j in np.argsort(-share[k], kind="stable").tolist() if share[k, j] > 0]
                        pred.append(model.languages[top[k]])
                        score.append(min(1.0, float(share[k, top[k]])))
                        sets.append(",".join(f"{model.languages[j]}:{share[k, j]:.3f}" for j in some))
                    else:
                        pred.append("und")
                        score.append(0.0)
                        sets.append("")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 3: 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """Learns from docs (doc_id, text, lang) outside the held-out fold and predicts every row: doc_id, held_out, lang_pred,
    score, languages. A null doc_id is in no fold: its row isn't learnt from and isn't held out."""
    model = fit(docs.where(fold(F.col("doc_id")) != 1))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def accuracy(predicted: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Rows and share of right predictions by held_out, for tests and reports."""
    truth = docs.where("lang is not null").select("doc_id", "lang")
    return predicted.join(truth, "doc_id").groupBy("held_out").agg(F.count("*").alias("rows"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).toPandas()
