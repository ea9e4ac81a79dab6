"""Registered queries of review decisions, renames, exclusive edges, unpublished changes, full nodes and paths, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import short_hash
from ..operators import diff, iterate, lookup, review
from ..operators.shared import cut, shared_dir
from ..sources.snapshots import SnapshotStore
from . import project
from .project import read
from .queries import _ADJ, _DIFF, _NODE_DIFF, _edges, _node_states, _snapshot, query


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size > 40 THEN 'rejected' WHEN p_size > 25 THEN 'pending' ELSE 'accepted' END AS status,
  CASE WHEN p_size > 40 OR p_size < 10 THEN 'finance' END AS decided_by FROM part""", graph=False)
def merge_reject(s, d):
    """Proposals after the rejection of some, of which those that were decided before stay as they were."""
    part = read(s, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    proposals = part.select("id", F.when(F.col("p_size") > 25, "pending").otherwise("accepted").alias("status"))
    asked = part.where("p_size > 40 or p_size < 10").select("id", F.lit("finance").alias("by"), F.lit("2024-01-01").alias("at"))
    return review.reject_merges(proposals, asked).select("id", "status", "decided_by")


def located_suppliers(s: SparkSession, d: str) -> DataFrame:
    """s_suppkey, s_name, s_acctbal, n_nationkey, n_name, n_regionkey."""
    joined = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "s_name", "s_acctbal", "n_nationkey", "n_name", "n_regionkey")


@query("""WITH l AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  e AS (SELECT * FROM l WHERE s_acctbal < 8000 AND s_acctbal >= 0 AND n_regionkey <> 4)
  SELECT 'edge' AS kind, s_suppkey AS item FROM e UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM e)
  UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 5000 OR s_suppkey IN (SELECT s_suppkey FROM e)""", graph=False)
def review_decisions(s, d):
    """What is imported of suppliers, nations and edges between them after a review: suppliers in debt and nations of one region are
    rejected, rich suppliers and most edges accepted; the rest waits, or is pulled in by an edge."""
    at, nation = cut(located_suppliers(s, d), "located"), read(s, d, "nation")
    key = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string")).alias("item_id")
    nodes = at.select(key("supplier", "s_suppkey"), F.col("s_name").alias("mention"))
    nodes = nodes.unionByName(nation.select(key("nation", "n_nationkey"), F.col("n_name").alias("mention")))
    edges = at.select(key("edge", "s_suppkey"), F.col("s_name").alias("source_mention"), F.col("n_name").alias("target_mention"))
    word = F.when(F.col("s_acctbal") < 0, "reject").when(F.col("s_acctbal") > 5000, "accept")
    verdicts = at.select(key("supplier", "s_suppkey"), word.alias("verdict")).where("verdict is not null")
    verdicts = verdicts.unionByName(nation.where("n_regionkey = 4").select(key("nation", "n_nationkey"), F.lit("reject").alias("verdict")))
    verdicts = verdicts.unionByName(at.where("s_acctbal < 8000").select(key("edge", "s_suppkey"), F.lit("accept").alias("verdict")))
    kept = [x.select("item_id") for x in review.review_items(nodes, edges, verdicts)]
    split = F.split("item_id", "-")
    return kept[0].unionByName(kept[1]).select(split[0].alias("kind"), split[1].cast("long").alias("item"))


@query("""SELECT 'nation-' || s_nationkey AS run_id, s_suppkey AS item, CASE WHEN s_acctbal < 0 THEN 'Former ' || s_suppkey ELSE s_name END AS source_mention,
  n_name AS target_mention FROM supplier JOIN nation ON s_nationkey = n_nationkey""", graph=False)
def renamed_mentions(s, d):
    """Ends of edges after suppliers in debt were renamed, each in the run of its nation, by names in other letters."""
    run = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("run_id")
    at = cut(located_suppliers(s, d), "located")
    edges = at.select(run, F.col("s_suppkey").alias("item"), F.col("s_name").alias("source_mention"), F.col("n_name").alias("target_mention"))
    new = F.concat(F.lit("Former "), F.col("s_suppkey").cast("string")).alias("new")
    return review.rename_mentions(edges, at.where("s_acctbal < 0").select(run, F.upper("s_name").alias("old"), new)).select(*edges.columns)


@query("""WITH e AS (SELECT DISTINCT user_id AS u, event_type AS t FROM events), f AS (SELECT min(t) AS t FROM e)
  SELECT 'user-' || x.u AS source_id, 'system/shop' AS target_ref, least(x.u || '/' || x.t, y.u || '/' || y.t) AS a, greatest(x.u || '/' || x.t, y.u || '/' || y.t) AS b
  FROM e x JOIN e y ON x.u = y.u AND x.t <> y.t WHERE y.t = (SELECT t FROM f)""", graph=False)
def exclusive_edges(s, d):
    """Pairs of edges that exclude each other: a user's events of every type name the first type as their opposite."""
    seen = cut(read(s, d, "events").select("user_id", "event_type").distinct(), "seen")
    first = seen.agg(F.min("event_type").alias("first"))  # one row
    edges = seen.crossJoin(first).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"),
        F.lit("system/shop").alias("target_ref"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("id"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type") != F.col("first"), F.to_json(F.struct(F.array("first").alias("excludes")))).alias("attrs"),
    )
    return review.exclusive_pairs(edges)


@query(f"""{_DIFF}, {_NODE_DIFF} SELECT 'edge' AS element, substr(sha1(source_id || '|' || type || '|' || target_ref), 1, 12) AS key, kind FROM de
  UNION ALL SELECT 'node', id, kind FROM dn""")
def working_changes(s, d):
    """Changes of unpublished nodes and edges against the newest of two published versions."""
    before, now = _node_states(s, d)
    store = SnapshotStore(s, f"{shared_dir(s)}/graphloom/working-{uuid.uuid4().hex}")
    compared = ("source_id", "type", "target_ref", "confidence", "status")
    store.publish("first", {"nodes": now, "edges": _snapshot(s, d, False).select(*compared)}, {})
    late = store.load("edges", store.latest(1)[0])  # as stored, it isn't derived again
    store.publish("second", {"nodes": before, "edges": _snapshot(s, d, True).select(*compared)}, {})
    nodes, edges = diff.diff_working(store, {"nodes": now, "edges": late})
    key = short_hash(F.concat_ws("|", "source_id", "type", "target_ref")).alias("key")
    return edges.select(F.lit("edge").alias("element"), key, "kind").unionByName(nodes.select(F.lit("node").alias("element"), F.col("id").alias("key"), "kind"))


@query("""SELECT n.id, n.type, name, alias, description, n.status, coalesce(outgoing, 0)::BIGINT AS outgoing, coalesce(incoming, 0)::BIGINT AS incoming FROM nodes n
  LEFT JOIN (SELECT source_id AS id, count(*) AS outgoing FROM edges GROUP BY ALL) o USING (id)
  LEFT JOIN (SELECT target_id AS id, count(*) AS incoming FROM edges GROUP BY ALL) i USING (id)""")
def full_nodes(s, d):
    """All fields of every node by its typed reference, with the numbers of its edges."""
    nodes, edges = cut(project.nodes(s, d), "nodes"), cut(_edges(s, d), "edges")
    found = lookup.get_nodes(nodes, nodes.select(F.concat_ws("/", "type", "id").alias("ref")))
    tied = lookup.edges_of(edges, found.select("id")).groupBy(F.col("node_id").alias("id"))
    counts = tied.agg(*[F.count(F.when(F.col("direction") == w, 1)).alias(name) for w, name in (("out", "outgoing"), ("in", "incoming"))])
    return found.join(counts, "id", "left").na.fill(0, ["outgoing", "incoming"]).select("id", "type", "name", "alias", "description", "status", "outgoing", "incoming")


_STEP = "list_append(seen, c.dst) AS seen, list_append(path, c.edge_id) AS path, p.cost + c.cost AS cost FROM {p} p JOIN c ON id = src WHERE NOT list_contains(seen, c.dst)"


@query(f""", {_ADJ}, c AS (SELECT src, dst, edge_id, round(-ln(weight) * 1e12)::BIGINT AS cost FROM adj),
  p1 AS (SELECT src AS source, dst AS id, [src, dst] AS seen, [edge_id] AS path, cost FROM c WHERE src LIKE 'rule-%'),
  p2 AS (SELECT source, c.dst AS id, {_STEP.format(p='p1')}), p3 AS (SELECT source, c.dst AS id, {_STEP.format(p='p2')}),
  p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
  SELECT source, id AS target, row_number() OVER (PARTITION BY source, id ORDER BY cost, len(path), path)::INT AS rank,
    floor(exp(-cost / 1e12) * 10000 + 0.5) / 10000 AS strength, len(path)::INT AS hops, array_to_string(path, ',') AS path
  FROM p WHERE id LIKE 'policy-%' QUALIFY rank <= 10""")
def rule_policy_paths(s, d):
    """The ten strongest paths of up to three hops from every rule to every policy."""
    nodes, edges = project.nodes(s, d), cut(_edges(s, d).select("id", "source_id", "target_id", "type", "confidence"), "edges")
    rules, policies = (nodes.where(F.col("type") == t).select(F.col("id").alias(c)) for t, c in (("rule", "source"), ("policy", "target")))
    found = iterate.strongest_paths(rules.crossJoin(policies), nodes, edges, 10, 3)  # all pairs are asked for
    return found.select("source", "target", "rank", "strength", "hops", F.array_join("path", ",").alias("path"))
