"""The stored adjacency: no exchange of edges in a hop, hubs in slices, the same results as from a plain table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import iterate, traversal
from graphloom.sources import derived


def star(spark, leaves=200, others=60, seed=2):
    rng = random.Random(seed)
    pairs = [("hub", f"n{k:03d}") for k in range(leaves)] + [(f"n{rng.randrange(leaves):03d}", f"m{k}") for k in range(others)]
    pairs += pairs[:5] + [("n000", "n000")]
    rows = [(f"e{k}", a, rng.choice(["DEPENDS_ON", "GOVERNS", "PART_OF"]), b, rng.random()) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, source_id string, type string, target_id string, confidence double")


def exchanges_of_edges(df):
    """Names of the exchanges that stand over a scan of edges, from the plan's indentation."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found, path = [], []
    for line in plan:
        depth = len(re.match(r"[\s:+\-]*", line).group())
        path = [p for p in path if p[0] < depth] + [(depth, line.strip())]
        if "FileScan" in line and "edge_id" in line:
            found += [p[1] for p in path if "Exchange" in p[1]]
    return found


@pytest.mark.parametrize("hub_edges", [1_000_000, 20])
def test_a_hop_exchanges_no_edges(spark, hub_edges):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        adj = derived.store_adjacency(traversal.adjacency(star(spark)), buckets=5, hub_edges=hub_edges)
        rows = spark.createDataFrame([("q", "hub"), ("q", "n001")], "origin string, at string")
        hop = adj.follow(rows, "at")
        assert (adj.hubs is None) == (hub_edges > 1000)
        assert exchanges_of_edges(hop) == [] and "Bucketed: true" in hop._jdf.queryExecution().executedPlan().toString()
        plain = traversal.adjacency(star(spark))
        cols = ["origin", "at", "dst", "edge_id"]
        assert sorted(map(tuple, hop.select(*cols).collect())) == sorted(map(tuple, derived.follow(rows, plain, "at").select(*cols).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hubs_edges_are_dealt_over_slices(spark):
    adj = derived.store_adjacency(traversal.adjacency(star(spark)), buckets=4, hub_edges=20)
    per_slice = {r["slice"]: r["n"] for r in adj.edges.where("src = 'hub'").groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert len(per_slice) >= 9 and max(per_slice.values()) <= 40
    assert adj.edges.where("src <> 'hub' and slice > 0").count() == 0


@pytest.mark.parametrize("hub_edges", [1_000_000, 20])
def test_stored_and_plain_adjacencies_give_the_same(spark, hub_edges, tmp_path):
    edges = star(spark)
    plain = traversal.adjacency(edges)
    derived.store_adjacency(plain, str(tmp_path), 3, hub_edges)
    adj = derived.open_adjacency(spark.newSession(), str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    origins = spark.createDataFrame([("hub",), ("n003",), ("m7",), ("gone",)], "origin string")
    assert rows(derived.degree_rows(plain).select("src", "degree", F.round("weighted", 9), F.round("pair_weight", 9))) == rows(adj.degrees.select("src", "degree", F.round("weighted", 9), F.round("pair_weight", 9)))
    assert rows(traversal.reach(origins, plain, 2)) == rows(traversal.reach(origins, adj, 2))
    jaccard = lambda a: rows(traversal.weighted_jaccard(origins, a).select("origin", "id", F.round("jaccard", 9)))
    assert jaccard(plain) == jaccard(adj) != []
    seeds = origins.select(F.col("origin").alias("query_id"), F.col("origin").alias("id"), F.lit(1.0).alias("score"))
    active = lambda a: rows(iterate.spreading_activation(seeds, a, 2)[0].select("query_id", "id", F.round("score", 9), "distance"))
    assert active(plain) == active(adj)


def test_jaccard_equals_a_plain_count(spark):
    edges = star(spark, 30, 40)
    weights = {}
    for r in traversal.adjacency(edges).collect():
        own = weights.setdefault(r.src, {})
        own[r.dst] = max(own.get(r.dst, 0), r.weight)
    adj = derived.store_adjacency(traversal.adjacency(edges), buckets=2, hub_edges=10)
    origin = "n004"
    want = {}
    for n, b in weights.items():
        least = sum(min(w, b[k]) for k, w in weights[origin].items() if k in b)
        if n != origin and least:
            want[n] = round(least / (sum(weights[origin].values()) + sum(b.values()) - least), 9)
    got = traversal.weighted_jaccard(spark.createDataFrame([(origin,)], "origin string"), adj).collect()
    assert {r.id: round(r.jaccard, 9) for r in got} == want
