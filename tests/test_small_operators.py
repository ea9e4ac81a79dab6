"""Operators without a query of their own."""

from pyspark.sql import functions as F

from graphloom.operators import evidence, retrieve, review


def test_pairs_that_exclude_each_other(spark):
    rows = [("e1", "a", "GOVERNS", "x/b", '{"excludes":["VALIDATES"]}'), ("e2", "a", "VALIDATES", "x/b", None), ("e3", "a", "VALIDATES", "x/c", None), ("e4", "a", "CALCULATES", "x/b", "{}")]
    df = spark.createDataFrame(rows, "id string, source_id string, type string, target_ref string, attrs string")
    assert [tuple(r) for r in review.exclusive_pairs(df).collect()] == [("a", "x/b", "e1", "e2")]


def test_resolutions_must_be_well_formed(spark):
    rows = [("1", "w", "s", "active"), ("2", None, "s", "active"), ("3", "w", None, "deprecated"), ("4", "w", "s", "gone"), ("5", "w", "s", "deprecated")]
    df = spark.createDataFrame(rows, "edge_id string, winner string, evidence_set string, status string")
    assert sorted(r.edge_id for r in evidence.well_formed_resolutions(df).collect()) == ["1", "5"]


def test_explore_starts_from_known_nodes(spark):
    nodes = spark.createDataFrame([(i, "entity", i) for i in "abc"], "id string, type string, name string")
    edges = spark.createDataFrame([("e1", "a", "DEPENDS_ON", "b", 0.9), ("e2", "b", "DEPENDS_ON", "c", 0.9), ("e3", "a", "DEPENDS_ON", "gone", 0.9)], "id string, source_id string, type string, target_id string, confidence double")
    own, near, touched = retrieve.explore(spark.createDataFrame([("a",), ("nobody",)], "origin string"), nodes, edges)
    assert [r.id for r in own.collect()] == ["a"]
    assert {(r.origin, r.id, r.distance) for r in near.select("origin", F.col("id"), "distance").collect()} == {("a", "a", 0), ("a", "b", 1)}
    assert {r.edge_id for r in touched.collect()} == {"e1", "e3"}


def test_diversification_by_other_measures(spark):
    """Similar are rows of one topic; relevant are those with many views, whatever their score."""
    rows = [("q", "a", 1.0, "x", 9), ("q", "b", 0.9, "x", 8), ("q", "c", 0.2, "y", 5), ("q", "d", 0.1, "z", 1), ("r", "e", 0.0, "x", 0)]
    pool = spark.createDataFrame(rows, "query_id string, id string, score double, topic string, views int")

    def one_topic(own):
        topic = own["topic"].to_numpy()
        return lambda i: (topic == topic[i]).astype(float)

    out = retrieve.mmr(pool, 3, 0.5, lambda own: own["views"].to_numpy(float) / 9, one_topic)
    assert [(r.query_id, r.id, r.nth) for r in out.orderBy("query_id", "nth").collect()] == [("q", "a", 1), ("q", "c", 2), ("q", "d", 3), ("r", "e", 1)]
