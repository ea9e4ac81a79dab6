"""Versioned tables: snapshots, the run log, the merge ledger."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "aliases", "edges", "evidence")


RUN_SCHEMA = "id string, seq long, parent long, branch string, attempt string, stats map<string,string>"


class CommitConflict(RuntimeError):
    """Another writer has published on the branch since this version's parent."""


class SnapshotStore:
    """Graph versions below a root folder. A version is written whole to `<table>/snapshot_id=<id>/attempt=<name>`, and counts once its
    row is in `runs`, a log with one file for each version, named by its number. A file is created only if there is none of that
    name, so of two writers that follow one version one fails; what it wrote is under its own attempt and is never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        there, fs = self._path(path)
        return fs.exists(there)

    def _create(self, path: str, text: str) -> bool:
        """Creates a file, or returns False if it is there. Atomic: locally by a link, elsewhere by the store's create without
        overwriting."""
        there, fs = self._path(path)
        if fs.getUri().getScheme() == "file":
            local = there.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            own = os.path.join(os.path.dirname(local), f"_{uuid.uuid4().hex}")  # Spark passes over names like this
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(own, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        try:
            out = fs.create(there, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def head(self, branch: str = "main") -> int:
        """Number of a branch's newest version, 0 if it has none."""
        return self.runs(branch).agg(F.max("seq")).head()[0] or 0

    def publish(self, snapshot_id: str, tables: dict[str, DataFrame], run: dict | None = None, branch: str = "main", parent: int | None = None) -> int:
        """Writes tables as a version that follows `parent`, the head of the branch that they were made from (by default the present
        one), and returns its number. A name that is taken is a ValueError, on a branch too; a CommitConflict if the branch has
        moved on, before anything is written or at the end. Branches share the numbers, but only their own versions conflict."""
        parent = self.head(branch) if parent is None else parent

        def check() -> None:
            if not self.runs(None).where(F.col("id") == snapshot_id).isEmpty():
                raise ValueError(f"snapshot {snapshot_id} exists")
            if (now := self.head(branch)) != parent:
                raise CommitConflict(f"{branch} is at {now}; {snapshot_id} was made from {parent}")

        check()
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}/attempt={attempt}")
        while True:
            seq = (self.runs(None).agg(F.max("seq")).head()[0] or 0) + 1
            check()
            row = {"id": snapshot_id, "seq": seq, "parent": parent, "branch": branch, "attempt": attempt, "stats": {k: str(v) for k, v in (run or {}).items()}}
            if self._create(f"{self.root}/runs/{seq:020d}.json", json.dumps(row)):
                return seq

    def load(self, table: str, snapshot_id: str) -> DataFrame:
        """A table at a version: one folder, so others aren't listed."""
        attempt = self.runs(None).where(F.col("id") == snapshot_id).head()["attempt"]
        return self.spark.read.parquet(f"{self.root}/{table}/snapshot_id={snapshot_id}/attempt={attempt}")

    def runs(self, branch: str | None = "main") -> DataFrame:
        """The log's rows of a branch (None: of all), by id."""
        path = f"{self.root}/runs"
        r = self.spark.read.schema(RUN_SCHEMA).json(path) if self._exists(path) else self.spark.createDataFrame([], RUN_SCHEMA)
        return (r if branch is None else r.where(F.col("branch") == branch)).orderBy("id")

    def latest(self, n: int = 2, branch: str = "main") -> list[str]:
        """Ids of the newest versions, newest first."""
        return [r.id for r in self.runs(branch).orderBy(F.desc("seq")).limit(n).collect()]

    def save_ledger(self, name: str, rows: DataFrame, snapshot_id: str) -> None:
        rows.orderBy("id").write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")

    def load_ledger(self, name: str, snapshot_id: str, schema: str) -> DataFrame:
        """The ledger of a version; empty if there is none."""
        path = f"{self.root}/{name}/snapshot_id={snapshot_id}"
        return self.spark.read.parquet(path).orderBy("id") if self._exists(path) else self.spark.createDataFrame([], schema)

