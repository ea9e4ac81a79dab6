"""What the projection exchanges, and its edges on odd rows against the plain operators."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions.ids import edge_id
from graphloom.operators import evidence
from graphloom.plans import project, queries

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
DAY = [datetime(1995, 1, 1), datetime(1997, 1, 1), None]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    flags, keys = ["A", "N", "R", None], [1, 2, None]
    lines = [
        (keys[i % 3] if i % 11 else 3, keys[i % 2] if i % 7 else None, keys[i // 2 % 2] if i % 5 else None, i % 4 if i % 13 else None, 1.0, float(i % 3), 0.08 * (i % 2), 0.03 * (i % 4), flags[i % 4], "F" if i % 3 else "O", DAY[i % 3])
        for i in range(240)
    ]
    rows = {
        "lineitem": (lines, LINE),
        "orders": ([(1, 7, "O", 1.0, DAY[0], "1"), (1, 7, "O", 1.0, DAY[0], "1"), (2, 8, "O", 1.0, DAY[0], "1"), (3, 9, "O", 1.0, DAY[0], "1"), (4, 7, "O", 1.0, DAY[0], "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(7, "a", 0, 1.0, "X"), (8, "b", 0, 1.0, None), (10, "c", 0, 1.0, "Y")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(1, "p", "b", "T", 1, 1.0), (5, "q", "b", "T", 1, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, "s", 0, 1.0), (6, "t", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "r"), (1, "none")], "r_regionkey int, r_name string"),
        "events": ([(1, DAY[0], 7, "e", 1.0, ""), (2, DAY[1], 7, "e", 1.0, "")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def plain_lines(spark, d):
    """Evidence of DEPENDS_ON, spelled out before it is compared."""
    c, text = F.col, lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    out = None
    for kind, key in (("entity", "l_partkey"), ("system", "l_suppkey")):
        target = text("entity-part-" if kind == "entity" else "system-supplier-", key)
        ref, source = F.concat(F.lit(f"{kind}/"), target), text("process-order-", "l_orderkey")
        part = x.select(
            edge_id(F.lit("DEPENDS_ON"), source, ref).alias("owner_id"), source.alias("source_id"), ref.alias("target_ref"),
            F.when(c("l_returnflag") == "A", "code").when(c("l_returnflag") == "N", "document").otherwise("interview").alias("source_type"),
            F.concat(text('{"line":', "l_linenumber"), text(',"order":', "l_orderkey"), F.lit("}")).alias("locator"),
            F.concat(text("line ", "l_linenumber"), F.lit(" flag "), "l_returnflag").alias("excerpt"),
            F.when((c("l_linestatus") == "F") & (c("l_discount") >= 0.08), "contradicts").otherwise("supports").alias("stance"),
            F.when((c("l_returnflag") == "R") & (c("l_tax") >= 0.06), "finance").alias("validated_by"),
            c("l_shipdate").alias("o1"), c("l_partkey").alias("o2"), c("l_suppkey").alias("o3"), c("l_extendedprice").alias("o4"), c("l_tax").alias("o5"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def test_edges_of_odd_lines_are_those_of_spelled_evidence(spark, tables):
    ev = evidence.dedup_evidence(plain_lines(spark, tables), [F.col(x).asc_nulls_first() for x in project.ORDER])
    keys = ["owner_id", "source_id", "target_ref"]
    want = sorted(map(str, evidence.score_edges(ev, keys).select(*keys, "confidence", "status", "n_evidence").collect()))
    got = project.edges(spark, tables, "DEPENDS_ON").withColumnRenamed("id", "owner_id")
    assert sorted(map(str, got.select(*keys, "confidence", "status", "n_evidence").collect())) == want and len(want) > 10
    own = project.evidence(spark, tables, "DEPENDS_ON")
    assert sorted(map(str, own.select("owner_id", "ev_key", "validated_by").collect())) == sorted(map(str, ev.select("owner_id", "ev_key", "validated_by").collect()))


def test_edges_are_compared_and_scored_where_their_order_lies(spark, tables):
    assert not [x for x in exchanges(project.edges(spark, tables)) if "owner_id" in x or "ev_key" in x or "source_id" in x]


def test_graph_stats_reads_the_lines_once(spark, tables):
    """only counts by type and status are summed up in the end."""
    out = queries.graph_stats(spark, tables)
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.metric, r.key): r.value for r in out.collect()}["edges_by_type", "PART_OF"] == 1


@pytest.mark.parametrize("name", ["stale_edges", "review_queue"])
def test_edges_are_judged_without_exchanging_evidence(spark, tables, name):
    """F16, F20: neither evidence nor edges are exchanged by their ids, places or order."""
    out = getattr(queries, name)(spark, tables)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and not [x for x in exchanges(out) if re.search(r"owner_id|ev_key|\bid#|_l#|source_id", x)]


def test_only_conflicted_edges_are_decided(spark, tables, monkeypatch):
    """the evidence of other edges isn't written."""
    seen = []
    monkeypatch.setattr(queries.review, "resolve_conflicts", lambda e, ev, asked: (seen.append((e, ev, asked)), None, e.selectExpr("id as edge_id", "'' as winner", "status", "'' as evidence_set"), None))
    queries.conflict_resolve(spark, tables)
    e, ev, asked = seen[0]
    clash = {r.id for r in project.edges(spark, tables).where("status = 'conflicted'").collect()}
    assert {r.id for r in e.collect()} == {r.edge_id for r in asked.collect()} == {r.owner_id for r in ev.select("owner_id").distinct().collect()} == clash and clash
    want = project.evidence(spark, tables).where(F.col("owner_id").isin(*clash)).select("owner_id", "ev_key", "stance")
    assert sorted(ev.select(*want.columns).collect()) == sorted(want.collect())


def test_kinds_of_edges_are_checked_once_each(spark, tables, monkeypatch):
    """what the ontology is asked about is a row for each kind of edge, not each edge."""
    asked, check = [], queries.validate.check_ends
    monkeypatch.setattr(queries.validate, "check_ends", lambda e, n: (asked.append(e.count()), check(e, n))[1])
    rows = {(r.type, r.source_type, r.target_type): (r.valid, r.n) for r in queries.ontology_violations(spark, tables).collect()}
    assert rows["EXECUTES", "role", "process"][0] is None or rows["EXECUTES", "role", "process"][0]
    edges = project.edges(spark, tables).count()
    assert asked[0] <= 2 * len(rows) < edges


def test_turns_are_numbered_by_ranges(spark, tables):
    """places within families, no task with a whole family; the same as by a window."""
    from pyspark.sql import Window as W

    from graphloom.operators import lookup, traversal

    rows = spark.range(500).select((F.col("id") % 3).alias("family"), F.concat(F.lit("x"), (F.col("id") * 7 % 499).cast("string")).alias("id"))
    got = lookup.numbered(rows, ["id"], "turn", ["family"])
    assert "Window [row_number" not in got._jdf.queryExecution().executedPlan().toString()
    want = rows.withColumn("turn", F.row_number().over(W.partitionBy("family").orderBy("id")))
    one = lambda df: sorted((r.family, r.turn, r.id) for r in df.collect())
    assert [x[:2] for x in one(got)] == [x[:2] for x in one(want)] and {x[2] for x in one(got)} == {x[2] for x in one(want)}
    assert one(traversal.interleave(rows, "family", ["id"])) == one(got)


def test_facet_refresh_broadcasts_no_nodes(spark, tables):
    """tables with a row for each node aren't sent to the driver, however small their files."""
    from graphloom.plans import changes

    out = changes.facet_refresh(spark, tables)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan
