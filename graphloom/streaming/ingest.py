"""Incremental import: batch files as a stream, one run for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import SCHEMAS, Graph, ImportResult, empty_graph, import_batch
from ..schemas import BATCH_SCHEMA
from ..sources.snapshots import CommitConflict, SnapshotStore


def current_graph(store: SnapshotStore, branch: str = "main") -> Graph:
    """The graph at a branch's newest version; a branch without versions starts from main's."""
    newest = store.latest(1, branch) or store.latest(1)
    return Graph(**{t: store.load(t, newest[0]).select(*store.spark.createDataFrame([], SCHEMAS[t]).columns) for t in SCHEMAS}) if newest else empty_graph(store.spark)


def import_run(store: SnapshotStore, batches: DataFrame, name: str, branch: str = "main", retries: int = 0, **thresholds) -> ImportResult:
    """Imports batches into a branch's newest version and publishes the outcome under a name, unless nothing changes. If another
    writer publishes meanwhile, a CommitConflict; with retries, the import is made again from the new version first."""
    while True:
        parent = store.head(branch)
        result = import_batch(current_graph(store, branch), batches, **thresholds)
        try:
            if not result.noop:
                store.publish(name, result.graph.tables(), result.stats.head().asDict(), branch, parent)
            return result
        except CommitConflict:
            if not retries:
                raise
            retries -= 1


def ingest_stream(spark: SparkSession, path: str, store: SnapshotStore, checkpoint: str, after: Callable[[Graph], None] | None = None, once: bool = True) -> StreamingQuery:
    """Imports JSON batches that appear below path. A micro-batch that is run again imports nothing new, since evidence has an
    identity of its own; so with the checkpoint's progress each file counts once. A batch that changes nothing publishes
    nothing. after: what follows each published version, such as a vector refresh."""

    def each(rows: DataFrame, epoch: int) -> None:
        result = import_batch(current_graph(store), rows)
        if not result.noop:
            tag = f"stream-{epoch:08d}"
            if store.runs(None).where(F.col("id") == tag).isEmpty():
                store.publish(tag, result.graph.tables(), result.stats.head().asDict())
            if after:
                after(result.graph)

    source = spark.readStream.schema(BATCH_SCHEMA).option("multiLine", True).json(path)
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changed_files(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, hash) tables -> (new or changed keys, removed keys)."""
    changed = current.join(stored.select("key", "hash"), ["key", "hash"], "left_anti")
    return changed, stored.join(current.select("key"), "key", "left_anti").select("key")


def with_hash(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return files.select(F.col(key).alias("key"), F.sha1(text).alias("hash"))
