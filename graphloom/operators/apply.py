"""Applying a resolved batch to graph tables, and the import run end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import edge_id, evidence_key, node_ref
from ..functions.text import normalize_alias
from . import validate
from .evidence import score_edges
from .resolve import resolve, resolve_edge_mentions
from .shared import cut


@dataclass
class Graph:
    """nodes (id, type, name, description, status, attrs), aliases (node_id, pos, alias), edges (id, source_id, type, target_ref,
    target_id, confidence, status, attrs, n_evidence), evidence (owner_id, pos, source_type, locator, excerpt, stance,
    validated_by, run, ev_key)."""

    nodes: DataFrame
    aliases: DataFrame
    edges: DataFrame
    evidence: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "aliases": self.aliases, "edges": self.edges, "evidence": self.evidence}


SCHEMAS = {
    "nodes": "id string, type string, name string, description string, status string, attrs string",
    "aliases": "node_id string, pos int, alias string",
    "edges": "id string, source_id string, type string, target_ref string, target_id string, confidence double, status string, attrs string, n_evidence long",
    "evidence": "owner_id string, pos long, source_type string, locator string, excerpt string, stance string, validated_by string, run string, ev_key string",
}


def empty_graph(spark) -> Graph:
    return Graph(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})


def _evidence_of(rows: DataFrame, stance: str | None) -> DataFrame:
    e = rows.select("owner_id", F.col("pos").cast("long").alias("pos"), "source_type", F.col("evidence.locator").alias("locator"), F.coalesce("evidence.excerpt", F.lit("")).alias("excerpt"), (F.col(stance) if stance else F.lit("supports")).alias("stance"), F.col("evidence.validated_by").alias("validated_by"), F.col("run_id").alias("run"))
    return e.withColumn("ev_key", evidence_key())


def add_evidence(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, added): stored evidence first, then new rows by run and position; the first of each owner and key stays."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("owner_id", "ev_key").orderBy("run", "pos"))).where("_n = 1").drop("_n")
    added = first.join(old.select("owner_id", "ev_key"), ["owner_id", "ev_key"], "left_anti").select(*old.columns)
    return old.unionByName(added), added


def apply_nodes(graph: Graph, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (run_id, pos, node_id, mention, type, name, description, attrs) onto the graph -> (nodes, aliases).

    A new node takes its first row's fields; a stored one keeps its own, takes a description if it has none, and attributes
    that it lacks. Mentions, and further names, become aliases unless their folded form is the name's or another alias's."""
    w = W.partitionBy("node_id").orderBy("run_id", "pos")
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = nodes.withColumn("_n", F.row_number().over(w)).withColumn("_d", F.first(text("description"), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    as_map = lambda c: F.coalesce(F.from_json(F.col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    head = rows.where("_n = 1").select(F.col("node_id").alias("id"), F.col("type").alias("_t"), F.col("name").alias("_name"), "_d", F.col("attrs").alias("_a"))
    j = graph.nodes.join(head, "id", "full")
    merged = F.map_filter(as_map("_a"), lambda k, v: ~F.map_contains_key(as_map("attrs"), k))
    attrs = F.when(F.col("_a").isNull() | F.col("id").isNull(), F.col("attrs")).when(F.col("attrs").isNull(), F.col("_a")).when(F.size(merged) > 0, F.to_json(F.map_concat(as_map("attrs"), merged))).otherwise(F.col("attrs"))
    out = j.select("id", F.coalesce("type", "_t").alias("type"), F.coalesce("name", "_name").alias("name"), F.coalesce(text("description"), "_d", "description").alias("description"), F.coalesce("status", F.lit("active")).alias("status"), attrs.alias("attrs"))
    asked = nodes.select(F.col("node_id"), "run_id", "pos", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("mention").alias("alias")), F.struct(F.lit(1).alias("o"), F.col("name").alias("alias")))).alias("x")).select("node_id", "run_id", "pos", "x.*")
    known = graph.aliases.select("node_id", normalize_alias("alias").alias("f")).unionByName(out.select(F.col("id").alias("node_id"), normalize_alias("name").alias("f")))
    fresh = asked.withColumn("f", normalize_alias("alias")).where("f <> ''").join(known.distinct(), ["node_id", "f"], "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy("node_id", "f").orderBy("run_id", "pos", "o"))).where("_n = 1")
    last = graph.aliases.groupBy("node_id").agg((F.max("pos") + 1).alias("_base"))
    place = F.row_number().over(W.partitionBy("node_id").orderBy("run_id", "pos", "o")) - 1
    added = fresh.withColumn("_p", place).join(last, "node_id", "left").select("node_id", (F.col("_p") + F.coalesce("_base", F.lit(0))).cast("int").alias("pos"), "alias")
    return out, graph.aliases.unionByName(added)


def apply_edges(graph: Graph, new: DataFrame, evidence: DataFrame) -> DataFrame:
    """new (id, source_id, type, target_ref, target_id, attrs, run_id, pos) with all evidence -> edges, scored anew. Attributes
    come with creation only, without any conflict_resolution in them; what deprecated an edge stays."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("run_id", "pos"))).where("_n = 1")
    clean = F.when(F.col("attrs").contains("conflict_resolution"), F.to_json(F.map_filter(F.from_json("attrs", "map<string,string>"), lambda k, v: k != "conflict_resolution"))).otherwise(F.col("attrs"))
    made = first.join(graph.edges.select("id"), "id", "left_anti").select("id", "source_id", "type", "target_ref", "target_id", F.lit(0.0).alias("confidence"), F.lit("active").alias("status"), clean.alias("attrs"), F.lit(0).cast("long").alias("n_evidence"))
    every = graph.edges.unionByName(made)
    score = score_edges(evidence, ["owner_id"]).select(F.col("owner_id").alias("id"), F.col("confidence").alias("_c"), F.col("status").alias("_s"), F.col("n_evidence").alias("_n"))
    status = F.when(F.col("status") == "deprecated", "deprecated").otherwise(F.coalesce("_s", "status"))
    return every.join(score, "id", "left").select("id", "source_id", "type", "target_ref", "target_id", F.coalesce("_c", "confidence").alias("confidence"), status.alias("status"), "attrs", F.coalesce("_n", F.lit(0)).cast("long").alias("n_evidence"))


def edge_ends(edges: DataFrame, resolutions: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with source_id, target_id, target_ref and id; edges whose ends have no decision or node)."""
    r = resolutions.select("run_id", "mention", "node_id").distinct()
    end = lambda a: r.select("run_id", F.col("mention").alias(f"{a}_mention"), F.col("node_id").alias(f"{a}_id"))
    e = edges.join(end("source"), ["run_id", "source_mention"], "left").join(end("target"), ["run_id", "target_mention"], "left")
    e = e.join(nodes.select(F.col("id").alias("target_id"), F.col("type").alias("_t")), "target_id", "left").withColumn("target_ref", node_ref("_t", "target_id"))
    e = e.withColumn("id", edge_id("type", "source_id", "target_ref"))
    sound = F.col("source_id").isNotNull() & F.col("_t").isNotNull()
    return e.where(sound).drop("_t"), e.where(~sound).drop("_t")


@dataclass
class ImportResult:
    graph: Graph
    stats: DataFrame
    rejections: DataFrame
    resolutions: DataFrame
    proposals: DataFrame
    noop: bool


def import_batch(graph: Graph, batches: DataFrame, known_proposals: DataFrame | None = None, **thresholds) -> ImportResult:
    """Validates, resolves and applies batches. Importing the same again changes nothing: evidence has an identity of its own, and
    names resolve to the nodes that they made."""
    nodes, edges, rejections = validate.validate(batches)
    nodes, edges = cut(nodes, "valid-nodes"), cut(edges, "valid-edges")
    resolutions, proposals = resolve(nodes, graph.nodes, graph.aliases, **thresholds)
    resolutions = cut(resolutions, "resolutions")
    if known_proposals is not None:
        proposals = proposals.join(known_proposals.select("id"), "id", "left_anti")
    bare = resolve_edge_mentions(edges, resolutions, graph.nodes, graph.aliases)
    all_res = cut(resolutions.select("run_id", "mention", "node_id").unionByName(bare.select("run_id", "mention", "node_id")), "decisions")
    placed = nodes.join(resolutions.select("run_id", "mention", "node_id"), ["run_id", "mention"])
    extra = bare.where("action = 'new'").select("run_id", F.lit(1 << 30).alias("pos"), "node_id", "mention", F.lit("entity").alias("type"), F.col("mention").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("attrs"))
    fields = ["run_id", "pos", "node_id", "mention", "type", "name", "description", "attrs"]
    new_nodes, new_aliases = apply_nodes(graph, placed.select(*fields).unionByName(extra.select(*fields)))
    new_nodes, new_aliases = cut(new_nodes, "nodes"), cut(new_aliases, "aliases")
    ended, lost = edge_ends(edges, all_res, new_nodes)
    ended = cut(ended, "edges-in")
    if not lost.isEmpty():
        raise ValueError("edges without a resolved end")
    fresh = _evidence_of(placed.withColumn("owner_id", F.col("node_id")), None).unionByName(_evidence_of(ended.withColumn("owner_id", F.col("id")), "stance"))
    every, added = add_evidence(graph.evidence, fresh)
    every, added = cut(every, "evidence"), cut(added, "evidence-added")
    new_edges = cut(apply_edges(graph, ended, every), "edges")
    stats = run_stats(graph, Graph(new_nodes, new_aliases, new_edges, every), added, rejections, proposals)
    stats = cut(stats, "stats")
    row = stats.head().asDict()
    return ImportResult(Graph(new_nodes, new_aliases, new_edges, every), stats, rejections, resolutions, proposals, is_noop(row))


def run_stats(before: Graph, after: Graph, added: DataFrame, rejections: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: nodes and edges created and updated (created ones aren't updated), evidence added, rejected, proposals."""
    alias = lambda g: g.aliases.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))

    def changed(a: DataFrame, b: DataFrame, cols: list[str], touched: DataFrame) -> DataFrame:
        old = a.select("id", F.struct(*cols).alias("old"))
        j = b.select("id", F.struct(*cols).alias("new")).join(old, "id", "left").join(touched.select(F.col("owner_id").alias("id"), F.lit(True).alias("hit")).distinct(), "id", "left")
        return j.agg(F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old").isNotNull() & ((F.col("old") != F.col("new")) | F.col("hit").isNotNull())).alias("updated"))

    with_alias = lambda g: g.nodes.join(alias(g), "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).fillna("", ["description", "attrs"])
    n = changed(with_alias(before), with_alias(after), ["name", "description", "attrs", "aliases"], added).toDF("nodes_created", "nodes_updated")
    e = changed(before.edges, after.edges, ["confidence", "status"], added).toDF("edges_created", "edges_updated")
    rest = [added.agg(F.count("*").alias("evidence_added")), rejections.agg(F.count("*").alias("rejected")), proposals.agg(F.count("*").alias("proposals"))]
    out = n.join(e, F.lit(True))
    for r in rest:
        out = out.join(r, F.lit(True))  # all are single rows
    return out


def is_noop(stats: dict) -> bool:
    return not any(stats[k] for k in ("nodes_created", "nodes_updated", "edges_created", "edges_updated", "evidence_added", "proposals"))


def run_id(source: str, at) -> str:
    """Name of a run by its UTC time."""
    return f"{at:%Y-%m-%dT%H-%M-%S}-{source}"
