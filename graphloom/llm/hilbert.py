"""Approximate nearest neighbours by shifted space-filling curves (numbered operator 8).

Every curve rotates the vectors by its own random projection to a few dimensions, shifts them, and orders them by their place
on a Hilbert curve. Spark range-partitions each ordering into blocks; a query is compared with the blocks in a window around
its own place, and its best from all windows and curves are merged.

The window is a share of the ordering, not a number of rows, so recall doesn't fall as the table grows. Vectors that point
everywhere alike have near neighbours hardly nearer than others, and need a wide window; clustered ones do with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Copies of one vector that are kept apart before the smallest ids are taken, so that no task gets all of them.
SALTS = 64


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows x dimensions, integers below 2**bits); dimensions * bits <= 62.

    Follows J. Skilling's "Programming the Hilbert curve" (2004): undo the excess work from the highest bit down, Gray-encode,
    and interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """Random projections, shifts and grids, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.longest, self.bits = longest, bits
        self.axes = [np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0] for _ in range(curves)]
        self.low, self.step = [], []
        for a in self.axes:
            p = self._lift(sample) @ a
            low, high = np.percentile(p, [0.5, 99.5], axis=0)
            span = np.maximum(high - low, 1e-12)
            shift = rng.random(p.shape[1]) / 4  # each ordering cuts space at other places
            self.low.append(low - shift * span)
            self.step.append(span * 1.25 / (1 << bits))

    def _lift(self, x: np.ndarray) -> np.ndarray:
        """A last component makes all lengths equal, so that near in the lifted space is a large inner product."""
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]])

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        y = self._lift(x)
        top = (1 << self.bits) - 1
        return [hilbert_index(np.clip((y @ a - low) / step, 0, top).astype(np.int64), self.bits) for a, low, step in zip(self.axes, self.low, self.step)]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = 4, dims: int = 4, bits: int = 8, window: float = 0.4, block_rows: int = 4096, block_queries: int = 4096, sample: int = 10_000, seed: int = 8) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows; the score is the inner product
    in double precision. Each query gets the k best that its windows hold (all candidates, if there are fewer), best first,
    ties to the smaller vec_id.

    Rows with a null vec_id or embedding, a null or non-finite component, only zeros, or another length than most rows take no
    part. Equal vectors are searched for once, by their k + 1 smallest ids, of which any query can use k at most; repeated
    rows count once. window: the share of an ordering that a query is compared
    with, in whole blocks and one block more; it is widened where it would hold fewer than k + 1 vectors. Curves are fitted on `sample` rows.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = good.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)")
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("v") == sizes[0].n).withColumn("same", F.concat_ws(":", F.hex(F.xxhash64("v")), F.hex(F.hash("v"))))
    # Equal vectors become one row with their smallest ids.
    salted = good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).groupBy("same", "salt").agg(F.collect_set("vec_id").alias("ids"), F.first("v").alias("v"))
    few = F.slice(F.sort_array("ids"), 1, k + 1)
    asks = F.exists("ids", lambda i: i % every == 0)
    salted = salted.select("same", few.alias("ids"), asks.alias("asks"), "v")
    classes = salted.groupBy("same").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.max("asks").alias("asks"), F.first("v").alias("v"))
    classes = materialise(classes.select("same", few.alias("ids"), "asks", "v"), "vectors")
    count, longest = classes.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).head()
    fitted = classes.orderBy(F.xxhash64("same")).limit(sample).select("v").toPandas()
    shape = Curves(np.stack(fitted["v"].tolist()), longest, curves, dims, bits, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, key in enumerate(shape.keys(_matrix(b.column(2))) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key), *b.columns], names=["curve", "place", *b.schema.names])

    blocks = max(8, -(-count // block_rows))
    placed = classes.select("same", "asks", "v").mapInArrow(place, "curve int, place long, same string, asks boolean, v array<double>")
    placed = materialise(placed.repartitionByRange(curves * blocks, "curve", "place", "same").withColumn("block", F.spark_partition_id()), "curves")
    ends: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("curve", "block").agg(F.count("*").alias("n")).collect():  # a row for each block
        ends.setdefault(r.curve, {})[r.block] = r.n

    def enough(width: int) -> bool:
        """Whether so many blocks in a row hold k + 1 vectors, wherever they lie."""
        for own in ends.values():
            sizes = [own.get(b, 0) for b in range(min(own), max(own) + 1)]
            if width < len(sizes) and min(sum(sizes[i : i + width]) for i in range(len(sizes) - width + 1)) <= k:
                return False
        return True

    longest_curve = max(max(own) - min(own) + 1 for own in ends.values())
    least = next(w for w in range(1, longest_curve + 1) if enough(w))
    first = F.create_map(*[F.lit(x) for c in sorted(ends) for x in (c, min(ends[c]))])
    size = F.create_map(*[F.lit(x) for c in sorted(ends) for x in (c, max(ends[c]) - min(ends[c]) + 1)])
    queries = placed.where("asks").select("curve", "block", F.col("same").alias("query"), F.col("v").alias("q"))
    width = F.least(F.col("size"), F.greatest(F.lit(least), F.ceil(F.col("size") * window).cast("int") + 1))
    queries = queries.withColumn("first", first[F.col("curve")]).withColumn("size", size[F.col("curve")]).withColumn("width", width)
    left = F.greatest(F.col("first"), F.least(F.col("block") - F.floor(F.col("width") / 2).cast("int"), F.col("first") + F.col("size") - F.col("width")))
    parts = max(1, int(-(-classes.where("asks").count() * (window + 2 / blocks) // block_queries)))
    queries = queries.select("query", "q", F.explode(F.sequence(left, left + F.col("width") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"))
    rows = placed.select("block", "same", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "found": [], "score": []}, dtype=object)
        score = np.stack(queries["q"].tolist()) @ np.stack(rows["v"].tolist()).T
        most = min(k + 1, score.shape[1])
        best = np.argpartition(-score, most - 1, axis=1)[:, :most]
        kth = np.take_along_axis(score, best, 1).min(1)
        names, out = rows["same"].to_numpy(), []
        for q, s, least, top in zip(queries["query"], score, kth, best):
            top = np.flatnonzero(s >= least) if (s == least).sum() > 1 else top  # ties stay
            out.append((q, names[top].tolist(), s[top].tolist()))
        return pd.DataFrame(out, columns=["query", "found", "score"])

    found = rows.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(compare, "query string, found array<string>, score array<double>")

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        """The best classes of a query from all its windows; those that tie with the last stay."""
        score: dict[str, float] = {}
        for names, values in zip(parts["found"], parts["score"]):
            score.update(zip(names, values))
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
        least = ranked[min(k, len(ranked) - 1)][1]
        ranked = [x for x in ranked if x[1] >= least]
        return pd.DataFrame({"query": parts["query"].iloc[0], "same": [x[0] for x in ranked], "score": [x[1] for x in ranked]})

    best = found.groupBy("query").applyInPandas(merge, "query string, same string, score double")
    named = best.join(classes.select("same", "ids"), "same").select("query", F.explode("ids").alias("vec_id"), "score")
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, 2 * (k + 1)).alias("best"))
    asked = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("same").alias("query")).distinct()
    answers = asked.join(lists, "query").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    answers = answers.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score"))
