"""Cutting lineage between iterations, and joins on keys that many rows share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task of a split join takes from each side.
HOT_ROWS = 20_000


def shared_dir(spark) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Only a local session, whose driver and executors are one
    process, may leave it unset: a temporary folder is set for it then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it again, so that plans don't grow and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """The inner join on some columns. Keys with more than `rows` rows on a side are split: that side's rows are dealt over slices, and
    the other side's rows of the key go to each slice, so a task gets at most about `rows` rows of a key from either side."""
    rows = rows or HOT_ROWS
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name)).where(F.col(name) > rows)
    slices = lambda c: F.coalesce(F.ceil(F.col(c) / rows).cast("int"), F.lit(1)).alias(c)
    hot = cut(count(left, "_l").join(count(right, "_r"), on, "full").select(*on, slices("_l"), slices("_r")), "hot")
    if hot.isEmpty():
        return left.join(right, on)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.join(hot, on, "left").na.fill(1, ["_l", "_r"])
        out = out.withColumn(f"{own}_at", F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int"))
        return out.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_l", "_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*on, "_l_at", "_r_at"]).drop("_l_at", "_r_at")
