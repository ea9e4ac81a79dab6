"""A sparse symmetric matrix over the nodes of a graph in blocks, times dense blocks of vectors.

Nodes are dealt over parts of bounded size. A part's vectors are one numpy matrix, stored as bytes in one row; the matrix's entries are
rows of bytes too, a row for each chunk of the entries out of one part, so a node with very many edges is spread over chunks. A product
joins chunks with their part's vectors, gives the partial sums of every part that a chunk leads to, and adds them up by part: one
shuffle of partial sums, never of single products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: About so many nodes make a part, and so many entries a chunk.
PART_NODES, CHUNK_ENTRIES = 20_000, 500_000
BLOCKS = "part int, n int, x binary"


def _blocks(parts: list[int], xs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([len(x) for x in xs], pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in xs], pa.binary())], names=["part", "n", "x"])


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


@dataclass
class BlockMatrix:
    """index: id, part, at (place in the part); sizes: part, n (nodes of the part); chunks: the entries."""

    index: DataFrame
    sizes: DataFrame
    chunks: DataFrame
    nodes: int

    def start(self, columns: int) -> DataFrame:
        """Blocks of numbers that depend on the node's id and column alone."""
        uniform = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30) - 0.5 for k in range(columns)]

        def gather(rows: pa.Table) -> pa.Table:
            x = np.stack(rows["x"].to_numpy())[np.argsort(rows["at"].to_numpy())]
            return pa.Table.from_batches([_blocks([rows["part"][0].as_py()], [x])])

        return self.index.select("part", "at", F.array(*uniform).alias("x")).groupBy("part").applyInArrow(gather, BLOCKS)

    def times(self, x: DataFrame) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    own = _matrix(r["x"], r["n"])
                    src, part, at = (np.frombuffer(r[k], np.int32) for k in ("src", "part_to", "at_to"))
                    products = np.frombuffer(r["a"], np.float64)[:, None] * own[src]
                    # entries come in order of where they lead
                    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (at[1:] != at[:-1])])
                    sums = np.add.reduceat(products, first)
                    part, at = part[first], at[first]
                    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                    out = [(int(part[i]), at[i:j].tobytes(), sums[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "at", "sums"])

        def add(rows: pa.Table) -> pa.Table:
            part, n = rows["part"][0].as_py(), rows["n"][0].as_py()
            total = None
            for at, sums in zip(rows["at"].to_pylist(), rows["sums"].to_pylist()):
                at = np.frombuffer(at, np.int32)
                own = _matrix(sums, len(at))
                total = np.zeros((n, own.shape[1])) if total is None else total
                total[at] += own
            return pa.Table.from_batches([_blocks([part], [total])])

        sums = self.chunks.join(x, "part").select("n", "x", "src", "part_to", "at_to", "a").mapInArrow(partial, "part int, at binary, sums binary")
        return sums.join(self.sizes, "part").groupBy("part").applyInArrow(add, BLOCKS)

    def rows(self, x: DataFrame) -> DataFrame:
        """id, vector."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    own = _matrix(r["x"], r["n"])
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(own), pa.int32()), pa.array(np.arange(len(own)), pa.int32()), vectors], names=["part", "at", "vector"])

        return x.mapInArrow(split, "part int, at int, vector array<double>").join(self.index.select("id", "part", "at"), ["part", "at"]).select("id", "vector")


def block_matrix(entries: DataFrame) -> BlockMatrix | None:
    """entries (src, dst, a), both directions of a symmetric matrix, each pair once; None if there are none."""
    ids = entries.select(F.col("src").alias("id")).distinct()
    nodes, total = ids.count(), entries.count()
    if not nodes:
        return None
    parts = -(-nodes // PART_NODES)
    dealt = ids.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    w = W.partitionBy("part")
    index = cut(dealt.select("id", "part", (F.row_number().over(w.orderBy("id")) - 1).alias("at"), F.count("*").over(w).cast("int").alias("n")), "nodes")
    end = lambda c: index.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"), F.col("at").alias(f"{c}_at"))
    placed = entries.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_part").alias("part"), F.col("src_at").alias("src"), F.col("dst_part").alias("part_to"), F.col("dst_at").alias("at_to"), "a")
    placed = cut(placed, "entries")
    size = placed.groupBy("part").agg(F.ceil(F.count("*") / CHUNK_ENTRIES).cast("int").alias("chunks"))
    # Entries that lead to one part and place stay in one chunk; those of a large part are spread by where they lead.
    chunked = placed.join(size, "part") if total > CHUNK_ENTRIES else placed.withColumn("chunks", F.lit(1))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("part_to", "at_to"), F.col("chunks")).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        x = {c: rows[c].to_numpy() for c in ("src", "part_to", "at_to", "a")}
        order = np.lexsort((x["at_to"], x["part_to"]))
        data = [pa.array([x[c][order].astype(t).tobytes()], pa.binary()) for c, t in (("src", np.int32), ("part_to", np.int32), ("at_to", np.int32), ("a", np.float64))]
        return pa.Table.from_arrays([pa.array([rows["part"][0].as_py()], pa.int32()), *data], names=["part", "src", "part_to", "at_to", "a"])

    packed = chunked.groupBy("part", "chunk").applyInArrow(pack, "part int, src binary, part_to binary, at_to binary, a binary")
    return BlockMatrix(index, cut(index.select("part", "n").distinct(), "sizes"), cut(packed, "matrix"), nodes)


def gram(x: DataFrame, y: DataFrame | None = None) -> np.ndarray:
    """The products of all columns of x with those of y (or of x); of the blocks' products only sums come to the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in b.to_pylist():
                own = _matrix(r["x"], r["n"])
                g = own.T @ (_matrix(r["y"], r["n"]) if "y" in r else own)
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    rows = x if y is None else x.join(y.select("part", F.col("x").alias("y")), "part")
    cells = rows.mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(cells))
    for r in cells:
        out[r.at] = r.v
    side = int(round(len(cells) ** 0.5))
    return out.reshape(side, side)


def turn(x: DataFrame, by: np.ndarray) -> DataFrame:
    """The blocks times a small matrix."""
    return _map(x, lambda own: own @ by)


def _map(x: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _blocks([r["part"]], [f(_matrix(r["x"], r["n"]))])

    return x.mapInArrow(work, BLOCKS)


def leading_eigenvectors(entries: DataFrame, dims: int, spare: int, rounds: int) -> DataFrame | None:
    """id, vector: the eigenvectors of the largest absolute eigenvalues, each times the root of its absolute eigenvalue; None for an
    empty matrix. Subspace iteration with `spare` columns more than wanted."""
    a = block_matrix(entries)
    if a is None:
        return None

    def orthonormal(x: DataFrame) -> DataFrame:
        x = cut(x, "vectors")
        values, vectors = np.linalg.eigh(gram(x))
        x = turn(x, vectors / np.sqrt(np.maximum(values, 1e-24)))
        values, vectors = np.linalg.eigh(gram(x))  # twice, for numerical safety
        return turn(x, vectors / np.sqrt(np.maximum(values, 1e-24)))

    x = orthonormal(a.start(min(dims + spare, a.nodes)))
    for r in range(rounds):
        x = a.times(x)
        if r % 5 == 4 or r == rounds - 1:  # powers up to five keep enough digits
            x = orthonormal(x)
    x = cut(x, "vectors")
    g = gram(x, a.times(x))
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = np.argsort(-np.abs(values))[: min(dims, a.nodes)]
    return a.rows(turn(x, vectors[:, keep] * np.sqrt(np.abs(values[keep]))))
