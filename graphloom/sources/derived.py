"""Derived tables on storage: an adjacency bucketed by node with its degrees, which traversals read without an exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import cut, shared_dir

#: Edges of a node that one task takes; nodes of more are hubs, whose edges are dealt over slices.
HUB_EDGES = 20_000


@dataclass
class Adjacency:
    """edges: src, dst and what else was given, bucketed and sorted by src (with hubs: by src and slice); degrees: src, degree, weighted
    (sum of weights), pair_weight (sum over neighbours of the largest weight), bucketed by src; hubs: src, slices of nodes of over
    HUB_EDGES edges, or None where there are none."""

    edges: DataFrame
    degrees: DataFrame
    hubs: DataFrame | None

    def follow(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with the edges out of the node in column `key`, one row for each edge. Only rows are exchanged, by node and slice."""
        edges = self.edges
        if self.hubs is None:
            return rows.join(edges, rows[key] == edges["src"]).drop("slice")
        spread = rows.join(self.hubs.withColumnRenamed("src", key), key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        return spread.drop("slices").join(edges, (F.col(key) == edges["src"]) & (F.col("_slice") == edges["slice"])).drop("_slice", "slice")


def follow(rows: DataFrame, adj: Adjacency | DataFrame, key: str) -> DataFrame:
    """As `Adjacency.follow`, for an adjacency that may be a plain table."""
    return adj.follow(rows, key) if isinstance(adj, Adjacency) else rows.join(adj, rows[key] == adj["src"])


def edges_of(adj: Adjacency | DataFrame) -> DataFrame:
    return adj.edges.drop("slice") if isinstance(adj, Adjacency) else adj


def degree_rows(adj: Adjacency | DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """src, degree, weighted, pair_weight. within: columns that are equal for all edges of a src and dst."""
    if isinstance(adj, Adjacency):
        return adj.degrees
    rows = adj if "weight" in adj.columns else adj.withColumn("weight", F.lit(1.0))
    pairs = rows.groupBy("src", *within, "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("m"))
    if within:
        pairs = pairs.groupBy("src", *within).agg(*[F.sum(c).alias(c) for c in ("n", "s", "m")])
    return pairs.groupBy("src").agg(F.sum("n").alias("degree"), F.sum("s").alias("weighted"), F.sum("m").alias("pair_weight"))


def _register(spark: SparkSession, path: str, schema: str, by: list[str], buckets: int) -> DataFrame:
    name = f"graphloom_{uuid.uuid4().hex}"
    keys = ", ".join(by)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, by: list[str], buckets: int) -> DataFrame:
    """Writes df to a folder in buckets by some columns, one file a bucket, and reads it as a bucketed table."""
    name = f"graphloom_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def store_adjacency(adj: DataFrame, path: str | None = None, buckets: int | None = None, hub_edges: int | None = None) -> Adjacency:
    """Writes adj (src, dst, ...; weights of 1 where it has none) with its degrees below a folder (a new one of the shared folder
    by default). adj is read twice, to find hubs and to write, so give what is read from storage. Edges are exchanged once; a hub's are dealt
    by dst, so that degrees are summed within buckets."""
    spark = adj.sparkSession
    path = path or f"{shared_dir(spark)}/graphloom/adjacency-{uuid.uuid4().hex}"
    buckets, most = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), hub_edges or HUB_EDGES
    slices = F.ceil(F.col("n") / most).cast("int")
    hubs = cut(adj.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src", slices.alias("slices")), "hubs")
    split = not hubs.isEmpty()
    if split:
        at = F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int")
        edges = write_bucketed(adj.join(hubs, "src", "left").select(*adj.columns, at.alias("slice")), f"{path}/edges", ["src", "slice"], buckets)
        hubs.write.parquet(f"{path}/hubs")
        hubs = spark.read.schema("src string, slices int").parquet(f"{path}/hubs")
    else:
        edges = write_bucketed(adj.withColumn("slice", F.lit(0)), f"{path}/edges", ["src"], buckets)
    degrees = write_bucketed(degree_rows(edges, ["slice"] if split else []), f"{path}/degrees", ["src"], buckets)
    layout = [(n, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema), by, buckets) for n, t, by in (("edges", edges, ["src", "slice"] if split else ["src"]), ("degrees", degrees, ["src"]))]
    spark.createDataFrame(layout, "name string, columns string, by array<string>, buckets int").coalesce(1).write.parquet(f"{path}/layout")
    return Adjacency(edges, degrees, hubs if split else None)


def open_adjacency(spark: SparkSession, path: str) -> Adjacency:
    """The adjacency that `store_adjacency` has written to a folder, in any session; its buckets still spare exchanges."""
    layout = {r["name"]: r for r in spark.read.parquet(f"{path}/layout").collect()}
    edges, degrees = (_register(spark, f"{path}/{n}", layout[n]["columns"], layout[n]["by"], layout[n]["buckets"]) for n in ("edges", "degrees"))
    split = "slice" in layout["edges"]["by"]
    return Adjacency(edges, degrees, spark.read.schema("src string, slices int").parquet(f"{path}/hubs") if split else None)
