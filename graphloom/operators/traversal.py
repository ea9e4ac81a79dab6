"""Bounded traversals: neighbourhoods, impact closures, structural measures, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import edge_weight
from ..sources.derived import Adjacency, degree_rows, follow, store_adjacency
from . import lookup
from .shared import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, edge_id, type, weight: both directions of every edge, without loops; weights are 1 where edges have no confidence."""
    weight = edge_weight() if "confidence" in edges.columns else F.lit(1.0)
    e = edges.where("source_id <> target_id").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("id").alias("edge_id"), "type", weight.alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "type", "weight"))


def degrees(adj: Adjacency | DataFrame, penalty: float = 0.3) -> DataFrame:
    """id, degree, weighted, damping (degree to the power of `penalty`)."""
    own = degree_rows(adj).select(F.col("src").alias("id"), "degree", "weighted")
    return own.withColumn("damping", F.pow(F.col("degree").cast("double"), F.lit(penalty)))


def reach(origins: DataFrame, hops: Adjacency | DataFrame, depth: int) -> DataFrame:
    """origins (origin) over hops (src, dst) -> origin, id, distance: the least number of hops, the origin itself at 0.

    One join a hop, which exchanges the newest nodes only if hops is a stored adjacency; nodes seen before drop out by an anti join;
    stops when a hop finds nothing new."""
    seen = cut(origins.select("origin", F.col("origin").alias("id"), F.lit(0).alias("distance")).distinct(), "reach")
    front = seen
    for d in range(1, depth + 1):
        new = follow(front.select("origin", F.col("id").alias("at")), hops, "at").select("origin", F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(origins: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, types: list[str] | None = None, adj: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """(origin, id, distance of existing nodes; origin, edge_id of edges at nodes nearer than `depth`). Undirected; missing
    nodes are passed through but not returned. adj: the stored adjacency of the edges of these types, if there is one."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    adj = adj or store_adjacency(adjacency(e))
    seen = reach(origins, adj, depth)
    inner = seen.where(F.col("distance") < depth).select("origin", F.col("id").alias("at"))
    loops = e.where("source_id = target_id").select(F.col("source_id").alias("at"), F.col("id").alias("edge_id"))
    touched = follow(inner, adj, "at").select("origin", "edge_id").unionByName(inner.join(loops, "at").select("origin", "edge_id")).distinct()
    return lookup.existing(seen, nodes), touched


def impact_edges(edges: DataFrame, upstream: bool = False) -> DataFrame:
    """src, dst, edge_id: the ways in which a change spreads: against DEPENDS_ON, along GOVERNS and TRIGGERS."""
    against = (F.col("type") == "DEPENDS_ON") if not upstream else (F.col("type") != "DEPENDS_ON")
    e = edges.where(F.col("type").isin("DEPENDS_ON", "GOVERNS", "TRIGGERS"))
    a, b = F.col("source_id"), F.col("target_id")
    return e.select(F.when(against, b).otherwise(a).alias("src"), F.when(against, a).otherwise(b).alias("dst"), F.col("id").alias("edge_id"))


def impact(origins: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "downstream", depth: int = 10) -> DataFrame:
    """origin, id, distance of the nodes that a change reaches (without the origin). direction: downstream, upstream or both;
    both is the union of the two, with the smaller distance. Unknown origins reach nothing."""
    known = origins.select("origin").join(nodes.select(F.col("id").alias("origin")), "origin", "left_semi")
    parts = [reach(known, store_adjacency(impact_edges(edges, up).select("src", "dst")), depth) for up in ((False, True) if direction == "both" else (direction == "upstream",))]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("origin", "id").agg(F.min("distance").alias("distance"))
    return lookup.existing(rows.where("distance > 0"), nodes)


def weighted_jaccard(origins: DataFrame, adj: Adjacency | DataFrame) -> DataFrame:
    """origins (origin) -> origin, id, jaccard: sum of minima over sum of maxima of the weights to common neighbours, for all
    nodes that share a neighbour with the origin. Two steps along the adjacency; those through a hub are dealt over its slices."""
    own = follow(origins.select("origin").distinct(), adj, "origin").groupBy("origin", F.col("dst").alias("mid")).agg(F.max("weight").alias("wa"))
    met = follow(own, adj, "mid").where("dst <> origin").select("origin", F.col("dst").alias("id"), "mid", "wa", "weight")
    # one exchange serves both sums: over parallel edges, then over common neighbours
    met = met.repartition("origin", "id").groupBy("origin", "id", "mid", "wa").agg(F.max("weight").alias("wb"))
    shared = met.groupBy("origin", "id").agg(F.sum(F.least("wa", "wb")).alias("least"))
    total = degree_rows(adj)
    a = total.select(F.col("src").alias("origin"), F.col("pair_weight").alias("ta"))
    b = total.select(F.col("src").alias("id"), F.col("pair_weight").alias("tb"))
    return shared.join(a, "origin").join(b, "id").select("origin", "id", (F.col("least") / (F.col("ta") + F.col("tb") - F.col("least"))).alias("jaccard"))


def interleave(rows: DataFrame, family: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Round robin over families, each in its own order; adds turn. The first `limit` rows, sorted by it, or all."""
    if not limit:
        return lookup.numbered(rows, order, "turn", [family]).withColumn("turn", F.col("turn").cast("int"))
    turn = F.row_number().over(W.partitionBy(family).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", family).limit(limit)


def coverage_gaps(nodes: DataFrame, edges: DataFrame, limit: int | None = 10, ends: DataFrame | None = None) -> DataFrame:
    """family, id: processes that nobody executes (1) or nothing triggers (2), isolated nodes (3), weak edges (4); in turn. ends (id): the nodes
    at edges' ends, if they are had for less than the edges."""
    process = nodes.where("type = 'process'").select("id")
    into = lambda t: edges.where(F.col("type") == t).select(F.col("target_id").alias("id"))
    parts = [process.join(into("EXECUTES"), "id", "left_anti"), process.join(into("TRIGGERS"), "id", "left_anti"), lookup.unlinked(nodes, edges if ends is None else ends).select("id"), lookup.weak(edges).select("id")]
    rows = parts[0].withColumn("family", F.lit(1))
    for k, p in enumerate(parts[1:], 2):
        rows = rows.unionByName(p.withColumn("family", F.lit(k)))
    return interleave(rows, "family", ["id"], limit)


#: How an edge is told.
TEMPLATES = {
    "OPERATES_ON": "La regla «{s}» opera sobre «{t}»",
    "VALIDATES": "La regla «{s}» valida «{t}»",
    "CALCULATES": "La regla «{s}» calcula «{t}»",
    "TRIGGERS": "«{s}» dispara «{t}»",
    "EXECUTES": "«{s}» ejecuta «{t}»",
    "DEPENDS_ON": "«{s}» depende de «{t}»",
    "GOVERNS": "La política «{s}» gobierna «{t}»",
    "IMPLEMENTED_IN": "«{s}» está implementado en «{t}»",
    "PART_OF": "«{s}» forma parte de «{t}»",
}
REFUTES = " — REFUTA lo afirmado por otra fuente"


def statement(type_: Column, source: Column, target: Column, stance: Column | None = None) -> Column:
    template = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])[type_]
    text = F.replace(F.replace(template, F.lit("{s}"), source), F.lit("{t}"), target)
    return text if stance is None else F.concat(text, F.when(stance == "contradicts", REFUTES).otherwise(""))


def verification_targets(nodes: DataFrame, edges: DataFrame, limit: int | None = 5) -> DataFrame:
    """edge_id, confidence, claim: weak edges with both ends there, weakest first."""
    name = lambda a: nodes.select(F.col("id").alias(f"{a}_id"), F.col("name").alias(f"{a}_name"))
    e = lookup.low_confidence(edges).join(name("source"), "source_id").join(name("target"), "target_id").orderBy("confidence", "source_id", "type", "target_ref")
    out = e.select(F.col("id").alias("edge_id"), "confidence", statement(F.col("type"), F.col("source_name"), F.col("target_name")).alias("claim"))
    return out.limit(limit) if limit else out
