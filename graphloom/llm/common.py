"""Shared pieces: a place for intermediate tables, and byte-level tokenising and hashing in numpy.

The numpy helpers work on the buffers of Arrow string columns, a bounded number of bytes at a time, so a task's memory
doesn't follow the length of its input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds in numpy form at once (a single longer text is held alone).
CHUNK_BYTES = 1 << 20
#: White space of the contracts: blank, and tab to carriage return.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Only a local session, whose driver and
    executors are one process, may leave it unset: a temporary folder is set for it then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows for the session, unless it has a number of its own: 10,000 whole texts, Spark's default, are tens of
    MB, which JVM and Python hold several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor loses nothing."""
    bound_batches(df.sparkSession)
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `materialise` has written for these, once nothing that is still to run reads them. The driver's garbage is
    collected too, as Spark keeps shuffle files of finished jobs until then."""
    spark = SparkSession.active()
    for t in tables:
        there = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------------------------
# Rows and filters

#: Cells of the filters that tell which rows of a scan may be wanted: so many rows are broadcast at most, whatever the input.
FILTER_CELLS = 1 << 20


def byte_at(table: bytes, at: Column) -> Column:
    """The byte of a table in the plan (values under 128) at a place."""
    return F.ascii(F.substring(F.lit(bytearray(table)), at.cast("int") + 1, F.lit(1)).cast("string"))


def stored_list(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    """The values as one row with one array, on storage. Plans read it by `scalar()`: as a literal, it would stand in all descriptions
    of these plans, which Spark keeps in the driver's memory (and 1 MB of bytes as 2 MB of hex digits)."""
    row = pa.array([values], pa.list_(pa.from_numpy_dtype(values.dtype)))
    return materialise(spark.createDataFrame(pa.table({"items": row})), name)


def filter_cells(hashes: DataFrame) -> DataFrame:
    """The hash cells of column h, as a small table on storage (FILTER_CELLS rows at most)."""
    cells = hashes.select(F.pmod("h", F.lit(FILTER_CELLS)).cast("int").alias("_cell")).groupBy("_cell").agg(F.lit(1))
    return materialise(cells.select("_cell"), "cells")


def maybe_in(rows: DataFrame, h: Column, cells: DataFrame, found: bool = True) -> DataFrame:
    """Rows whose hash falls in one of the cells; found=False: those that surely weren't among the hashed."""
    return rows.join(F.broadcast(cells), F.pmod(h, F.lit(FILTER_CELLS)).cast("int") == F.col("_cell"), "left_semi" if found else "left_anti")


def row_key() -> Column:
    """Rows of one doc_id and text are one document; other rows of one doc_id are told apart."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("rk")


# ---------------------------------------------------------------------------------------------------------------------
# Text as bytes


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) over runs of rows of at most `limit` bytes, or of one row.

    offsets has one more item than rows; a null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work that holds several copies of a batch or gives its texts back."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


def byte_classes(**members: bytes) -> np.ndarray:
    """A table from byte to class: members' classes count up from 0; bytes that none has get the next class."""
    out = np.full(256, len(members), np.uint8)
    for k, own in enumerate(members.values()):
        out[np.frombuffer(own, np.uint8)] = k
    return out


#: 0 white space, 1 all else.
WORDS = byte_classes(space=SPACE)


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, ...]:
    """Maximal runs of one class other than 0 within a document: (starts, ends, index of the document)."""
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            full = np.full(n + n // 4, x, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all others, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers, modulo 2**64, before each position."""
    n = len(data)
    up, _ = _powers(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes[start:end]; equal bytes have equal hashes, wherever they lie."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive tokens of one document, and the index of each one's first token."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += h[j : j + n]
    at = np.flatnonzero(doc[k - 1 :] == doc[:n])
    return mix(out[at]), at
