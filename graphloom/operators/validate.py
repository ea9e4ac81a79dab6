"""Validation of extraction batches against the ontology, keeping what is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import canonical_json
from ..functions.text import slug
from ..schemas import EDGE_TYPES, MAX_EXCERPT, NODE_TYPES, SCHEMA_VERSION, SOURCE_TYPES, STANCES, ontology
from ..sources.batches import batch_edges, batch_nodes


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(reason)) for cond, reason in checks]))


def _not_object(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.coalesce(F.col(c).rlike(r"(?s)^\s*\{.*\}\s*$") & canonical_json(c).isNotNull(), F.lit(False))


def node_reasons() -> Column:
    """Structural faults of batch nodes."""
    missing = [(F.col(f).isNull(), f"missing_field:{f}") for f in ("mention", "type", "name", "description", "evidence")]
    return _reasons(*missing, (F.col("type").isNotNull() & ~F.col("type").isin(*NODE_TYPES), "bad_enum:type"), (F.col("evidence").isNotNull() & F.col("evidence.locator").isNull(), "missing_field:evidence.locator"), (F.col("evidence").isNotNull() & F.col("evidence.excerpt").isNull(), "missing_field:evidence.excerpt"), (F.length("evidence.excerpt") > MAX_EXCERPT, "too_long:evidence.excerpt"), (_not_object("attrs"), "bad_type:attrs"), (_not_object("evidence.locator"), "bad_type:evidence.locator"))


def edge_reasons() -> Column:
    missing = [(F.col(f).isNull(), f"missing_field:{f}") for f in ("type", "source_mention", "target_mention", "evidence")]
    return _reasons(*missing, (F.col("type").isNotNull() & ~F.col("type").isin(*EDGE_TYPES), "bad_enum:type"), (F.col("stance").isNotNull() & ~F.col("stance").isin(*STANCES), "bad_enum:stance"), (F.col("evidence").isNotNull() & F.col("evidence.locator").isNull(), "missing_field:evidence.locator"), (F.col("evidence").isNotNull() & F.col("evidence.excerpt").isNull(), "missing_field:evidence.excerpt"), (F.length("evidence.excerpt") > MAX_EXCERPT, "too_long:evidence.excerpt"), (_not_object("attrs"), "bad_type:attrs"), (_not_object("evidence.locator"), "bad_type:evidence.locator"))


def _rejections(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    path = F.concat(F.lit(f"{kind}/"), F.col("pos").cast("string"))
    return rows.select("run_id", path.alias("path"), F.array_join("reasons", "; ").alias("reason"), F.to_json(F.struct(*columns)).alias("item"))


def duplicate_mentions(nodes: DataFrame) -> DataFrame:
    """nodes with first_pos: the position of the first node of the same run, type and slug of mention."""
    return nodes.withColumn("first_pos", F.min("pos").over(W.partitionBy("run_id", "type", slug("mention"))))


def mention_types(nodes: DataFrame) -> DataFrame:
    """run_id, key (slug of mention), types of the nodes that share it."""
    return nodes.groupBy("run_id", slug("mention").alias("key")).agg(F.array_sort(F.collect_set("type")).alias("types"))


def check_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with reasons: unknown ends, and types outside the ontology. An end whose mention names nodes of several types is
    sound if any of them is."""
    types = mention_types(nodes)
    end = lambda a: types.select("run_id", F.col("key").alias(f"_{a}"), F.col("types").alias(f"{a}_types"))
    e = edges.withColumn("_source", slug("source_mention")).withColumn("_target", slug("target_mention"))
    e = e.join(end("source"), ["run_id", "_source"], "left").join(end("target"), ["run_id", "_target"], "left")
    o = ontology(edges.sparkSession).groupBy(F.col("edge_type").alias("type")).agg(F.collect_set("source_type").alias("_ss"), F.collect_set("target_type").alias("_ts"))
    e = e.join(F.broadcast(o), "type", "left")  # one row for each of the nine edge types
    s, t = F.col("source_types"), F.col("target_types")
    both = s.isNotNull() & t.isNotNull()
    reasons = _reasons((s.isNull(), "unknown_source"), (t.isNull(), "unknown_target"), (both & ~F.arrays_overlap(s, "_ss"), "bad_source_type"), (both & ~F.arrays_overlap(t, "_ts"), "bad_target_type"), (both & (F.col("type") == "PART_OF") & F.arrays_overlap(s, "_ss") & F.arrays_overlap(t, "_ts") & ~F.arrays_overlap(F.array_intersect(s, "_ss"), t), "part_of_cross_type"))
    return e.withColumn("reasons", reasons).drop("_source", "_target", "_ss", "_ts")


def validate(batches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejections) of batches. A batch of another schema version, or without its root fields, is rejected whole.
    Faulty items drop with all their reasons; of nodes with one type and slug of mention the first stays; edges need ends among
    the nodes that stay and types that the ontology permits. Null stances become supports."""
    root = _reasons((F.col("run_id").isNull(), "missing_field:run_id"), (F.col("source_type").isNull(), "missing_field:source_type"), (F.col("nodes").isNull(), "missing_field:nodes"), (F.col("edges").isNull(), "missing_field:edges"), (F.col("source_type").isNotNull() & ~F.col("source_type").isin(*SOURCE_TYPES), "bad_enum:source_type"), (F.col("extractor").isNotNull() & F.col("extractor.name").isNull(), "missing_field:extractor.name"), (F.col("schema_version").isNotNull() & (F.col("schema_version") != SCHEMA_VERSION), "version_mismatch"))
    marked = batches.withColumn("reasons", root)
    bad = marked.where(F.size("reasons") > 0).select("run_id", F.lit("").alias("path"), F.array_join("reasons", "; ").alias("reason"), F.lit(None).cast("string").alias("item"))
    good = marked.where(F.size("reasons") == 0).drop("reasons")

    n, e = batch_nodes(good), batch_edges(good)
    nc, ec = n.columns, e.columns
    n = n.withColumn("reasons", node_reasons())
    blank = _reasons((F.trim("mention") == "", "blank_mention"), (F.trim("name") == "", "blank_name"))
    n = n.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(blank))
    sound = duplicate_mentions(n.where(F.size("reasons") == 0))
    doubles = sound.where("pos > first_pos").withColumn("reasons", F.array(F.concat(F.lit("duplicate_node:nodes/"), F.col("first_pos").cast("string"))))
    nodes = sound.where("pos = first_pos").select(*nc)

    e = e.withColumn("reasons", edge_reasons())
    checked = check_ends(e.where(F.size("reasons") == 0).drop("reasons"), nodes)
    edges = checked.where(F.size("reasons") == 0).select(*ec).withColumn("stance", F.coalesce("stance", F.lit("supports")))
    parts = [bad, _rejections(n.where(F.size("reasons") > 0), "nodes", nc), _rejections(doubles, "nodes", nc), _rejections(e.where(F.size("reasons") > 0), "edges", ec), _rejections(checked.where(F.size("reasons") > 0), "edges", ec)]
    return nodes, edges, reduce(DataFrame.unionByName, parts)
