"""Projections, filters and lookups over nodes, edges and evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..schemas import REVIEW_THRESHOLD
from .shared import cut


def list_nodes(nodes: DataFrame, types: Sequence[str] | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """id, type, name, summary, score 0; by id, a page at a time."""
    rows = nodes.where(F.col("type").isin(list(types))) if types else nodes
    return rows.orderBy("id").offset(offset).limit(limit).select("id", "type", "name", first_line("description").alias("summary"), F.lit(0.0).alias("score"))


def node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "name", first_line("description").alias("summary"))


def get_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes of typed references (ref `type/id`); a reference of another type finds nothing, one without a slash is an error."""
    ref = F.when(F.col("ref").contains("/"), F.col("ref")).otherwise(F.raise_error(F.concat(F.lit("no typed reference: "), F.col("ref"))))
    split = refs.select(F.substring_index(ref, "/", 1).alias("type"), F.regexp_extract(ref, "^[^/]*/(.*)$", 1).alias("id"))
    return nodes.join(split, ["type", "id"], "left_semi")


def numbered(rows: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with their place in an order from 1, within each value of `by` if that is given: sorted by ranges, and numbered from the sizes of
    the ranges before, so no task takes all rows of a value."""
    keys = [*by, *order]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    rows = cut(rows.withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = rows.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))  # a row for each range and value
    earlier = F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")
    before = sizes.select("_range", *by, (earlier - F.col("_first")).alias("_before"))
    return rows.join(F.broadcast(before), ["_range", *by]).withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """All edges with seq, their place in that order from 1."""
    return numbered(edges, ("source_id", "type", "target_ref"), "seq")


def edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of each node in ids (id): node_id, direction (out, then in); a loop is reported once, as out."""
    own = ids.select(F.col("id").alias("node_id")).distinct()
    out = edges.join(own, F.col("source_id") == F.col("node_id")).withColumn("direction", F.lit("out"))
    into = edges.join(own, (F.col("target_id") == F.col("node_id")) & (F.col("source_id") != F.col("node_id"))).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def weak(edges: DataFrame, threshold: float = REVIEW_THRESHOLD / 100) -> DataFrame:
    """Active edges below the threshold, in no order."""
    return edges.where((F.col("confidence") < threshold) & (F.col("status") == "active"))


def low_confidence(edges: DataFrame, threshold: float = REVIEW_THRESHOLD / 100) -> DataFrame:
    return weak(edges, threshold).orderBy("confidence", "source_id", "type", "target_ref")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of an edge. edges (source_id, target_id), or the ends themselves (id)."""
    return nodes.join(endpoints(edges) if "source_id" in edges.columns else edges, "id", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame, limit: int | None = 100) -> DataFrame:
    """Unlinked nodes by id."""
    out = unlinked(nodes, edges).orderBy("id")
    return out.limit(limit) if limit else out


def evidence_of(evidence: DataFrame, owners: DataFrame) -> DataFrame:
    """Evidence of owners (owner_id)."""
    return evidence.join(owners.select("owner_id").distinct(), "owner_id", "left_semi")


def orphans(rows: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows whose node is gone."""
    return rows.join(nodes.select(F.col("id").alias(key)), key, "left_anti")


def existing(rows: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose node is there."""
    return rows.join(nodes.select(F.col("id").alias(key)), key, "left_semi")


def with_nodes(hits: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Hits with their node's type, name and summary."""
    return hits.join(node_summary(nodes).withColumnRenamed("id", key), key)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between nodes of ids (id)."""
    a, b = ids.select(F.col("id").alias("source_id")), ids.select(F.col("id").alias("target_id"))
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None, min_confidence: float = 0.0, max_nodes: int = 10_000, max_edges: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals): a view of the graph; both ends of an edge are in view. totals has one row: nodes, edges (all
    of the graph's), truncated."""
    n = nodes.where(F.col("type").isin(list(types))) if types else nodes
    e = edges.where(F.col("confidence") >= min_confidence)
    e = e.where(F.col("status").isin(list(statuses))) if statuses else e
    kept = n.orderBy("id").limit(max_nodes)
    inside = induced(e, n)
    shown = induced(inside, kept).orderBy("source_id", "type", "target_ref").limit(max_edges)
    total = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")), F.lit(True))
    seen = n.agg(F.count("*").alias("_n")).join(inside.agg(F.count("*").alias("_e")), F.lit(True))
    totals = total.join(seen, F.lit(True)).select("nodes", "edges", ((F.col("_n") > max_nodes) | (F.col("_e") > max_edges)).alias("truncated"))
    return kept, shown, totals


def pending_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.where("status = 'pending'")


def revertible_merges(merges: DataFrame) -> DataFrame:
    return merges.where("reverted_at is null")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, value: totals, and counts by type and status (of nodes and edges together). Nodes and edges are each counted by type and
    status once; all else is sums of these few rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    few = edges.groupBy("type", "status").agg(F.count("*").alias("n"), F.count_if((F.col("confidence") < REVIEW_THRESHOLD / 100) & (F.col("status") == "active")).alias("low"), F.sum("n_evidence").alias("evidence"))
    few = few.select(F.lit("edges").alias("of"), "type", "status", "n", "low", "evidence")
    few = cut(few.unionByName(nodes.groupBy("type", "status").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("of"), "type", "status", "n", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("evidence"))), "counts")
    own = lambda x: few.where(F.col("of") == x)

    def facet(rows: DataFrame, metric: str, key: str | None = None, value: Column | str = "n") -> DataFrame:
        out = rows.groupBy(F.col(key).alias("key")) if key else rows
        return out.agg(total(value).alias("value")).select(F.lit(metric).alias("metric"), "key" if key else F.lit("").alias("key"), "value")

    parts = [
        facet(own("nodes"), "nodes"), facet(own("edges"), "edges"), facet(own("edges").where("status = 'conflicted'"), "open_conflicts"),
        facet(own("edges"), "low_confidence", None, "low"), facet(own("edges"), "evidence", None, "evidence"),
        facet(own("nodes"), "nodes_by_type", "type"), facet(own("edges"), "edges_by_type", "type"), facet(few, "by_status", "status"),
    ]
    return reduce(DataFrame.unionByName, parts)
