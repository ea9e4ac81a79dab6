"""Small graphs and texts with known answers."""

import datetime
import json
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids, similarity, text
from graphloom.operators import diff, evidence, iterate, lookup, resolve, retrieve, review, search, traversal, validate, vectors
from graphloom.operators.apply import empty_graph, import_batch, run_id
from graphloom.sources import batches, documents
from graphloom.sources.derived import edges_of
from graphloom.sources.snapshots import SnapshotStore
from graphloom.streaming.ingest import current_graph, ingest_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(("name", "want"), [("Línea de pedido", "linea-de-pedido"), ("  --A b!! ", "a-b"), ("Ñandú Ÿ", "nandu-y"), ("Заказ 7", "заказ-7")])
def test_slug(spark, name, want):
    assert value(spark, text.slug(F.lit(name))) == want


def test_ids(spark):
    assert value(spark, ids.node_id_for(F.lit("rule"), F.lit("Rule X"))) == "rule-x"
    assert value(spark, ids.node_id_for(F.lit("rule"), F.lit("Ruler"))) == "rule-ruler"
    assert value(spark, ids.ref_id(F.lit("entity/a/b"))) == "a/b" and value(spark, ids.ref_id(F.lit("ab"))) == "ab"
    assert value(spark, ids.canonical_json(F.lit('{"b":{"z":1,"a":2.0},"a":[1,2]}'))) == '{"a":[1,2],"b":{"a":2,"z":1}}'
    assert value(spark, ids.canonical_json(F.lit("{oops"))) is None
    row = spark.createDataFrame([("code", '{"b":1,"a":"x"}', 'say "hi"', None)], "source_type string, locator string, excerpt string, stance string")
    assert json.loads(row.select(ids.evidence_key().alias("k")).head().k) == {"excerpt": 'say "hi"', "locator": {"a": "x", "b": 1}, "source_type": "code", "stance": "supports"}


@pytest.mark.parametrize(("a", "b", "want"), [("cliente", "clientes", 1.0), ("", "x", 0.0), ("Crédito", "credito", 1.0), ("MRP Acme", "ERP Acme", 0.875)])
def test_name_similarity(spark, a, b, want):
    assert value(spark, similarity.name_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert value(spark, similarity.name_similarity(F.lit(b), F.lit(a))) == pytest.approx(want)


def test_vectors_and_rounding(spark):
    arr = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert value(spark, similarity.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, similarity.cosine(arr(0, 0), arr(1, 1))) == 0
    with pytest.raises(Exception, match="different lengths"):
        value(spark, similarity.cosine(arr(1), arr(1, 1)))
    assert value(spark, similarity.round4(F.lit(0.12345))) == 0.1235
    assert value(spark, similarity.calibrated(F.lit(0.9), 0.8)) == pytest.approx(0.5) and value(spark, similarity.calibrated(F.lit(0.2), 0.8)) == 0
    assert value(spark, text.segments(F.lit("Short. A sentence that is long enough; next one is fine too\nok"))) == ["Short.", "A sentence that is long enough;", "next one is fine too ok"]
    assert len(value(spark, text.clip_excerpt(F.lit("a" * 400)))) == 300


EV = "owner_id string, source_type string, locator string, excerpt string, stance string, validated_by string"


def ev(owner, source, stance="supports", loc=1, by=None, excerpt="e"):
    return owner, source, json.dumps({"n": loc}), excerpt, stance, by


def test_confidence_and_conflict(spark):
    rows = [ev("a", "code"), ev("b", "code"), ev("b", "document", loc=2), ev("c", "document"), ev("c", "interview"), ev("d", "interview", by="x"), ev("e", "interview", by="x"), ev("e", "document"), ev("f", "code"), ev("f", "code", loc=2), ev("f", "code", loc=3), ev("g", "code", "contradicts")]
    rows += [ev("h", "code"), ev("h", "code", "contradicts"), ev("i", "code"), ev("i", "code", "contradicts", 2), ev("j", "code"), ev("j", "document", "contradicts")]
    got = {r.owner_id: (r.confidence, r.status) for r in evidence.score_edges(spark.createDataFrame(rows, EV), ["owner_id"]).collect()}
    assert {k: v[0] for k, v in got.items() if k <= "g"} == {"a": 0.9, "b": 0.95, "c": 0.75, "d": 0.95, "e": 0.99, "f": 0.9, "g": 0.0}
    assert [got[k][1] for k in "hij"] == ["active", "conflicted", "conflicted"]


def test_first_evidence_wins(spark):
    rows = [(*ev("a", "code"), 2), (*ev("a", "code", by="x"), 1), (*ev("a", "code", loc=2), 3)]
    out = evidence.dedup_evidence(spark.createDataFrame(rows, EV + ", pos int"), [F.col("pos")])
    assert sorted((r.pos, r.validated_by) for r in out.collect()) == [(1, "x"), (3, None)]


def test_status_ladder(spark):
    edges = spark.createDataFrame([("1", "deprecated", True), ("2", "active", True), ("3", "active", True), ("4", "deprecated", True), ("5", "deprecated", True), ("6", "deprecated", False), ("7", "active", False)], "id string, status string, clash boolean")
    sets = spark.createDataFrame([(str(k), "now") for k in range(1, 8)], "owner_id string, evidence_set string")
    res = spark.createDataFrame([("3", "deprecated", "now"), ("4", "active", "old"), ("5", "deprecated", "old"), ("6", "deprecated", "old")], "edge_id string, status string, evidence_set string")
    got = {r.id: r.new_status for r in evidence.recompute_status(edges, sets, res).collect()}
    assert got == {"1": "deprecated", "2": "conflicted", "3": "deprecated", "4": "deprecated", "5": "conflicted", "6": "active", "7": "active"}


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame([(i, t, i, None, "active") for i, t in (("P", "policy"), ("A", "process"), ("e", "event"), ("B", "process"), ("R", "rule"), ("S", "system"))], "id string, type string, name string, description string, status string")
    rows = [("P", "GOVERNS", "A"), ("A", "TRIGGERS", "e"), ("e", "TRIGGERS", "B"), ("R", "DEPENDS_ON", "B"), ("R", "VALIDATES", "A"), ("S", "EXECUTES", "B"), ("A", "DEPENDS_ON", "ghost")]
    edges = spark.createDataFrame([(f"{s}{t}", s, y, f"x/{t}", t, 0.9, "active", 1) for s, y, t in rows], "id string, source_id string, type string, target_ref string, target_id string, confidence double, status string, n_evidence long")
    return nodes, edges


def test_traversal_toy(spark, toy):
    nodes, edges = toy
    origin = lambda x: spark.createDataFrame([(x,)], "origin string")
    reach = lambda x, way: {r.id: r.distance for r in traversal.impact(origin(x), nodes, edges, way).collect()}
    assert reach("P", "downstream") == {"A": 1, "e": 2, "B": 3, "R": 4}
    assert reach("R", "upstream") == {"B": 1, "e": 2, "A": 3, "P": 4}
    assert reach("nobody", "both") == {} and reach("A", "both") == {"e": 1, "B": 2, "R": 3, "P": 1}
    near, touched = traversal.neighbourhood(origin("A"), nodes, edges, 1)
    assert {r.id: r.distance for r in near.collect()} == {"A": 0, "P": 1, "e": 1, "R": 1}
    assert {r.edge_id for r in touched.collect()} == {"PA", "Ae", "RA", "Aghost"}
    assert lookup.isolated(nodes, edges.where("type = 'GOVERNS'")).count() == 4
    assert {(r.family, r.id) for r in traversal.coverage_gaps(nodes, edges).collect()} == {(1, "A"), (2, "A")}
    _, shown, totals = lookup.subgraph(nodes, edges, ["policy", "process"], max_nodes=1)
    assert shown.count() == 0 and totals.head().asDict() == {"nodes": 6, "edges": 7, "truncated": True}


def graph(spark, rows):
    ids_ = sorted({x for r in rows for x in r[:2]})
    nodes = spark.createDataFrame([(i,) for i in ids_], "id string")
    edges = spark.createDataFrame([(f"{k:02d}", s, "GOVERNS", t, t, c) for k, (s, t, c) in enumerate(rows)], "id string, source_id string, type string, target_ref string, target_id string, confidence double")
    return nodes, edges


def test_path_toy(spark):
    nodes, edges = graph(spark, [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5)])
    pairs = spark.createDataFrame([("a", "c"), ("a", "a")], "source string, target string")
    run = lambda **kw: [(r.source, r.target, r.strength, list(r.path)) for r in iterate.strongest_paths(pairs, nodes, edges, **kw).orderBy("target", "rank").collect()]
    assert run() == [("a", "a", 1.0, []), ("a", "c", 0.81, ["00", "01"]), ("a", "c", 0.5, ["02"])]
    assert run(k=1)[1:] == [("a", "c", 0.81, ["00", "01"])] and run(max_hops=1)[1:] == [("a", "c", 0.5, ["02"])]


def test_paths_against_all_loopless_paths(spark):
    rng = random.Random(1)
    rows = [(a, b, round(rng.uniform(0.3, 1), 2)) for a in "abcde" for b in "abcde" if a < b and rng.random() < 0.8] + [("a", "b", 0.77)]
    nodes, edges = graph(spark, rows)
    every = []
    for n in range(0, 4):
        for mid in permutations("bcd", n):
            walk = ["a", *mid, "e"]
            options = [[(f"{k:02d}", c) for k, (s, t, c) in enumerate(rows) if {s, t} == set(p)] for p in zip(walk, walk[1:])]
            stack = [([], 1.0)]
            for o in options:
                stack = [(p + [e], w * c) for p, w in stack for e, c in o]
            every += stack
    want = sorted((-w, len(p), ",".join(p)) for p, w in every if len(p) <= 4)[:5]
    got = iterate.strongest_paths(spark.createDataFrame([("a", "e")], "source string, target string"), nodes, edges, 5, 4).orderBy("rank").collect()
    assert [r.strength for r in got] == [pytest.approx(-w, abs=1e-4) for w, _, _ in want]


def test_pagerank_and_activation(spark):
    nodes, edges = graph(spark, [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 1.0), ("a", "c", 0.25)])
    adj = traversal.adjacency(edges)
    seeds = spark.createDataFrame([("q", "a", 1.0), ("q", "zz", 1.0), ("q", "b", -1.0)], "query_id string, id string, score double")
    rank = {r.id: r.rank for r in iterate.pagerank(seeds, adj).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-9)
    m = np.zeros((5, 5))
    name = "abcd"
    for s, t, c in [("a", "b", 1.0), ("b", "c", 0.5), ("c", "d", 1.0), ("a", "c", 0.25)]:
        m[name.index(s), name.index(t)] += c
        m[name.index(t), name.index(s)] += c
    p = np.divide(m, m.sum(1, keepdims=True), where=m.sum(1, keepdims=True) > 0, out=np.zeros_like(m))
    s = np.array([0.5, 0, 0, 0, 0.5])
    x = s.copy()
    for _ in range(30):
        x = 0.85 * (x @ p) + s * (0.15 + 0.85 * x[4])
    assert [rank[k] for k in "abcd"] == pytest.approx(list(x[:4]), abs=1e-5)
    total, passed = iterate.spreading_activation(seeds.where("id = 'a'"), adj, 1)
    got = {r.id: r.score for r in total.collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.6 / 2**0.3), "c": pytest.approx(0.15 / 2**0.3)} and passed.count() == 2


def test_spectral_embedding_matches_dense(spark):
    rng = random.Random(4)
    rows = [(f"n{a}", f"n{b}", 1.0) for a in range(12) for b in range(a) if (a < 6) == (b < 6) or rng.random() < 0.1]
    _, edges = graph(spark, rows)
    got = {r.id: np.array(r.vector) for r in iterate.spectral_embedding(traversal.adjacency(edges), 2, 8, 30).collect()}
    names = sorted(got)
    m = np.zeros((12, 12))
    for s, t, _ in rows:
        m[names.index(s), names.index(t)] = m[names.index(t), names.index(s)] = 1
    d = m.sum(1) ** -0.5
    values, vec = np.linalg.eigh(d[:, None] * m * d[None])
    keep = np.argsort(-np.abs(values))[:2]
    want = vec[:, keep] * np.sqrt(np.abs(values[keep]))
    x = np.stack([got[k] for k in names])
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-4)


def test_mmr(spark):
    rows = [("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.9, [1.0, 0.01]), ("q", "c", 0.5, [0.0, 1.0])]
    out = retrieve.mmr(spark.createDataFrame(rows, "query_id string, id string, score double, vector array<double>"), 3, 0.5)
    assert [r.id for r in out.orderBy("nth").collect()] == ["a", "c", "b"]


def test_search_phrases_prefixes_and_types(spark):
    docs = spark.createDataFrame([("1", "entity", "Pedido de cliente", "orden", "Un pedido urgente"), ("2", "rule", "Bloqueo", "", "pedido sin prepago, cliente"), ("3", "entity", "Otro", "", "nada")], "id string, type string, name string, aliases string, description string")
    q = lambda x, **kw: [r.id for r in search.search(spark.createDataFrame([("q", x)], "query_id string, query string"), docs, **kw).orderBy("rank").collect()]
    assert q("pedido cliente") == ["1", "2"] and q("PEDIDO", types=["rule"]) == ["2"] and q("sin-prepago") == ["2"]
    assert q("prepago-sin") == [] and q("pre*") == ["2"] and q("pedido ur*") == ["1"] and q("") == [] and q("pedido nowhere") == []


def test_aliases_roll_up_for_search(spark):
    nodes = spark.createDataFrame([("1", "entity", "Cliente", None), ("2", "entity", "Otro", "comprador")], "id string, type string, name string, description string")
    aliases = spark.createDataFrame([("1", 1, "comprador"), ("1", 0, "buyer")], "node_id string, pos int, alias string")
    docs = search.with_aliases(nodes, aliases)
    assert {r.id: (r.aliases, r.description) for r in docs.collect()} == {"1": ("buyer comprador", ""), "2": ("", "comprador")}
    found = search.search(spark.createDataFrame([("q", "comprador")], "query_id string, query string"), docs).orderBy("rank").collect()
    assert [r.id for r in found] == ["1", "2"]  # an alias weighs more than a description


def test_plan_vetoes_and_modes(spark):
    from graphloom.schemas import RetrievalConfig

    q = spark.createDataFrame([("a", "rule-bloqueo-de-pedido"), ("b", "dos palabras"), ("c", "Какой порядок у нас здесь")], "query_id string, query string")
    rows = {(r.query_id, r.channel): (r.enabled, r.weight) for r in retrieve.plan(q, RetrievalConfig("auto", {"multivec": False}), True).collect()}
    assert [c for c in retrieve.CHANNELS if rows["a", c][0]] == ["lexical"] and [c for c in retrieve.CHANNELS if rows["b", c][0]] == ["lexical", "semantic"]
    assert rows["c", "semantic"] == (True, 1.0) and not rows["c", "multivec"][0]
    assert not any(r.enabled for r in retrieve.plan(q, None, False).where("channel = 'semantic'").collect())


def test_context_invariants(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(f"d{k}", "entity", f"thing {k}", "", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8))) for k in range(40)], "id string, type string, name string, aliases string, description string")
    _, edges = graph(spark, [(f"d{rng.randrange(40)}", f"d{rng.randrange(40)}", 0.8) for _ in range(80)])
    queries = spark.createDataFrame([("q1", "alpha beta"), ("q2", "nothing here")], "query_id string, query string")
    from graphloom.schemas import RetrievalConfig

    kept, shown = retrieve.context(queries, docs, docs.select("id", "type", "name"), edges, RetrievalConfig(limit=4))
    rows = kept.collect()
    assert {r.query_id for r in rows} == {"q1"} and sum(r.seed for r in rows) == 4 and len(rows) <= 12
    assert all((r.distance == 0) == r.seed and bool(r.channels) == r.seed and r.score > 0 for r in rows)
    inside = {r.id for r in rows}
    ends = shown.join(edges.withColumnRenamed("id", "edge_id"), "edge_id").collect()
    assert len(ends) <= 12 and all(r.source_id in inside and r.target_id in inside for r in ends)


def test_similar_nodes_prefer_equal_structure(spark):
    nodes, edges = graph(spark, [("x", "h1", 1.0), ("x", "h2", 1.0), ("y", "h1", 1.0), ("y", "h2", 1.0), ("z", "h3", 1.0), ("h3", "h1", 1.0)])
    nodes = nodes.withColumn("name", F.col("id"))
    got = retrieve.similar_nodes(spark.createDataFrame([("x",)], "origin string"), nodes, edges).orderBy("rank").collect()
    assert got[0].id == "y"


def test_refresh_recomputes_only_what_changed(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "")], "id string, text string")
    table = vectors.refresh(spark.createDataFrame([], "id string, provider string, hash string, vector array<double>"), texts, "hash", vectors.hash_embedding)
    assert table.count() == 3
    plan = vectors.refresh_plan(table, texts.where("id <> 'b'").unionByName(spark.createDataFrame([("a2", "x")], texts.schema)), "hash")
    assert {r.id: r.action for r in plan.collect()} == {"a": "kept", "b": "drop", "c": "kept", "a2": "recompute"}
    made = vectors.model_embedding(texts, lambda t: [[len(x), 1.0] for x in t], "passage: ")
    assert {r.id: list(r.vector) for r in made.collect()}["a"] == [12.0, 1.0]
    assert vectors.pick_provider("auto", False) == "none"


def batch(run, nodes, edges, source="document", **more):
    one = lambda loc, by=None: {"locator": json.dumps({"doc_id": run, "section": loc}), "excerpt": f"x{loc}", "validated_by": by}
    return {"run_id": run, "source_type": source, "nodes": [{"mention": m, "type": t, "name": n, "description": "d", "evidence": one(m)} for m, t, n in nodes], "edges": [{"type": y, "source_mention": s, "target_mention": t, "evidence": one(s + t)} for y, s, t in edges]} | more


def frame(spark, *items):
    from graphloom.schemas import BATCH_SCHEMA

    return spark.read.schema(BATCH_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(x) for x in items]))


def test_validation_reasons(spark):
    b = batch("r", [("A", "process", "A"), ("a", "process", "again"), (" ", "rule", "x"), ("N", "thing", "x"), ("Q", "entity", "Q"), ("R", "rule", "R")], [("GOVERNS", "R", "A"), ("CALCULATES", "R", "Q"), ("CALCULATES", "R", "nobody"), ("CALCULATES", "R", "A"), ("PART_OF", "A", "Q"), ("NOPE", "R", "Q")])
    b["nodes"][4]["evidence"]["excerpt"] = "e" * 300
    b["edges"].append({**b["edges"][1], "evidence": {"locator": "[1]", "excerpt": "e" * 301}})
    nodes, edges, bad = validate.validate(frame(spark, b, batch("v2", [], [], schema_version=2)))
    assert sorted(r.mention for r in nodes.collect()) == ["A", "Q", "R"] and [(r.type, r.target_mention, r.stance) for r in edges.collect()] == [("CALCULATES", "Q", "supports")]
    got = {(r.run_id, r.path): r.reason for r in bad.collect()}
    assert got == {("v2", ""): "version_mismatch", ("r", "nodes/1"): "duplicate_node:nodes/0", ("r", "nodes/2"): "blank_mention", ("r", "nodes/3"): "bad_enum:type", ("r", "edges/0"): "bad_source_type", ("r", "edges/2"): "unknown_target", ("r", "edges/3"): "bad_target_type", ("r", "edges/4"): "part_of_cross_type", ("r", "edges/5"): "bad_enum:type", ("r", "edges/6"): "too_long:evidence.excerpt; bad_type:evidence.locator"}


def test_resolution(spark):
    nodes = spark.createDataFrame([("entity-cliente", "entity", "Cliente"), ("system-erp", "system", "ERP Acme")], "id string, type string, name string")
    aliases = spark.createDataFrame([("entity-cliente", "comprador")], "node_id string, alias string")
    asked = [("clientes", "entity"), ("comprador", "entity"), ("Cliente", "process"), ("MRP Acme", "system"), ("Bobina", "entity"), ("bobinas", "entity"), ("given", "entity")]
    rows = [("r", k, m, "entity-cliente" if m == "given" else None, t, m) for k, (m, t) in enumerate(asked)]
    out, proposals = resolve.resolve(spark.createDataFrame(rows, "run_id string, pos int, mention string, candidate_id string, type string, name string"), nodes, aliases)
    got = {r.mention: (r.action, r.node_id) for r in out.collect()}
    assert got == {"clientes": ("exact", "entity-cliente"), "comprador": ("exact", "entity-cliente"), "Cliente": ("new", "process-cliente"), "MRP Acme": ("provisional", "system-mrp-acme"), "Bobina": ("new", "entity-bobina"), "bobinas": ("batch", "entity-bobina"), "given": ("candidate", "entity-cliente")}
    assert [(r.source, r.target, r.score) for r in proposals.collect()] == [("system-mrp-acme", "system-erp", 0.875)]


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abs ") for _ in range(rng.randrange(1, 12))).strip() for _ in range(150)} - {""})
    df = spark.createDataFrame([(f"n{k:03d}", "entity", n) for k, n in enumerate(names)], "id string, type string, label string")
    pairs = resolve.similar_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b")).where("a < b")
    got = {(r.a, r.b): round(r.score, 9) for r in pairs.collect()}
    x, y = df.toDF("a", "t", "x"), df.toDF("b", "u", "y")
    brute = x.join(y, F.col("a") < F.col("b")).select("a", "b", similarity.name_similarity("x", "y").alias("score")).where("score >= 0.75")
    assert got == {(r.a, r.b): round(r.score, 9) for r in brute.collect()} and len(got) > 20


def test_grouping_matches_one_by_one(spark):
    rng = random.Random(6)
    rows = [("r", f"{k:03d}", k, "entity", " ".join(rng.choice(["caso", "casos", "bases", "base", "bas", "red"]) for _ in range(rng.randrange(1, 3)))) for k in range(40)]
    df = spark.createDataFrame(rows, "run_id string, mention_id string, pos int, type string, mention string")
    fuzzy = df.where("pos % 5 = 0").select("mention_id", F.lit("node").alias("node_id"), F.lit(0.95).alias("score"))
    keys = {r.mention_id: set(r.k) for r in df.select("mention_id", text.match_keys("mention").alias("k")).collect()}
    made, want = [], {}
    for _, m, k, _, _ in rows:
        hit = next((c for c in made if keys[c] & keys[m]), None)
        if hit:
            want[m] = ("joined", hit)
        elif k % 5 == 0:
            want[m] = ("stored", None)
        else:
            made.append(m)
            want[m] = ("created", m)
    assert {r.mention_id: (r.outcome, r.creator) for r in resolve.group_in_batch(df, fuzzy).collect()} == want


FIRST = batch("r1", [("Cliente", "entity", "Cliente"), ("Política P", "policy", "Política P"), ("Alta", "process", "Alta")], [("GOVERNS", "Política P", "Alta"), ("DEPENDS_ON", "Alta", "Cliente")], "code")


def test_import_twice_is_a_noop(spark):
    one = import_batch(empty_graph(spark), frame(spark, FIRST))
    assert one.stats.head().asDict() == {"nodes_created": 3, "nodes_updated": 0, "edges_created": 2, "edges_updated": 0, "evidence_added": 5, "rejected": 0, "proposals": 0} and not one.noop
    assert import_batch(one.graph, frame(spark, {**FIRST, "run_id": "r1"})).noop
    more = json.loads(json.dumps(FIRST | {"run_id": "r2", "source_type": "document"}))
    more["nodes"][0]["mention"] = "clientes"
    more["edges"][1]["target_mention"] = "clientes"
    two = import_batch(one.graph, frame(spark, more))
    assert {r.type: r.confidence for r in two.graph.edges.collect()} == {"GOVERNS": 0.95, "DEPENDS_ON": 0.95}
    assert [(r.node_id, r.alias) for r in two.graph.aliases.collect()] == [("entity-cliente", "clientes")]
    assert run_id("code", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "2024-01-02T03-04-05-code"


def test_merge_and_revert(spark):
    b = batch("r1", [("Alpha uno", "entity", "Alpha uno"), ("Zeta dos", "entity", "Zeta dos"), ("Alta", "process", "Alta"), ("Baja", "process", "Baja")], [("DEPENDS_ON", "Alta", "Alpha uno"), ("DEPENDS_ON", "Alta", "Zeta dos"), ("DEPENDS_ON", "Baja", "Zeta dos")])
    g = import_batch(empty_graph(spark), frame(spark, b)).graph
    asked = spark.createDataFrame([("m1", "entity-zeta-dos", "entity-alpha-uno"), ("m2", "process-alta", "entity-alpha-uno")], "id string, source string, into string")
    out = review.accept_merges(g.nodes, g.aliases, g.edges, g.evidence, asked)
    assert [(r.id, r.error) for r in out["errors"].collect()] == [("m2", "type_mismatch")]
    assert sorted((r.source_id, r.target_id, r.n_evidence) for r in out["edges"].collect()) == [("process-alta", "entity-alpha-uno", 2), ("process-baja", "entity-alpha-uno", 1)]
    assert [r.alias for r in out["aliases"].where("node_id = 'entity-alpha-uno'").collect()] == ["Zeta dos"]
    back = review.revert_merges(out["nodes"], out["edges"], out["evidence"], out["records"], asked.select("id"), "then")
    assert sorted((r.source_id, r.target_id) for r in back["edges"].collect()) == [("process-alta", "entity-alpha-uno"), ("process-baja", "entity-zeta-dos")]
    assert back["nodes"].count() == 4
    twice = review.revert_merges(back["nodes"], back["edges"], back["evidence"], back["records"], asked.select("id"), "then")
    assert [r.error for r in twice["errors"].collect()] == ["already_reverted"]
    chain = review.collapse_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, into string"))
    assert {r.source: r.into for r in chain.collect()} == {"a": "d", "b": "d", "c": "d"}


def test_verdicts_renames_and_stale(spark):
    g = import_batch(empty_graph(spark), frame(spark, FIRST)).graph
    edge = g.edges.where("type = 'GOVERNS'").head()
    nodes, edges = review.verdict_batch(g.edges, g.nodes, spark.createDataFrame([(edge.id, "refute", "jefe")], "edge_id string, verdict string, role string"), "i1")
    assert nodes.count() == 2 and [(r.stance, r.evidence.validated_by) for r in edges.collect()] == [("contradicts", "jefe")]
    flat_nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "item_id int, mention string")
    flat_edges = spark.createDataFrame([(4, "A", "B"), (5, "A", "C")], "item_id int, source_mention string, target_mention string")
    n, e = review.review_items(flat_nodes, flat_edges, spark.createDataFrame([(1, "accept"), (3, "reject"), (4, "accept"), (5, "accept")], "item_id int, verdict string"))
    assert sorted(r.mention for r in n.collect()) == ["A", "B"] and [r.item_id for r in e.collect()] == [4]
    moved = review.rename_mentions(flat_edges.withColumn("run_id", F.lit("r")), spark.createDataFrame([("r", "a", "Z")], "run_id string, old string, new string"))
    assert {r.source_mention for r in moved.collect()} == {"Z"}
    there = g.evidence.where(F.col("owner_id") != edge.id).select("source_type", "locator")
    assert {r.type: r.status for r in review.mark_stale(g.edges, g.evidence, there).collect()} == {"GOVERNS": "stale", "DEPENDS_ON": "active"}


def test_documents_round_trip_and_diff(spark, tmp_path):
    g = import_batch(empty_graph(spark), frame(spark, FIRST)).graph
    docs = batches.assemble_documents(g.nodes.withColumn("schema_version", F.lit(1)), g.aliases, g.edges, g.evidence)
    flat = batches.flatten_documents(batches.parse_documents(docs))
    again = batches.assemble_documents(flat["nodes"], flat["aliases"], flat["edges"], flat["evidence"])
    assert {(r.id, r.content_hash) for r in docs.collect()} == {(r.id, r.content_hash) for r in again.collect()}
    assert batches.changed_documents(again, docs).count() == 0
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("s1", g.tables(), {"n": 1})
    more = import_batch(g, frame(spark, batch("r2", [("Otro", "entity", "Otro"), ("Alta", "process", "Alta")], [("DEPENDS_ON", "Alta", "Otro")]))).graph
    store.publish("s2", more.tables())
    store.publish("b1", more.tables(), branch="draft")
    assert store.latest() == ["s2", "s1"] and store.latest(5, "draft") == ["b1"]
    with pytest.raises(ValueError):
        store.publish("s1", g.tables())
    a, b = (store.load("edges", s) for s in ("s1", "s2"))
    kinds = lambda x, y: sorted(r.kind for r in diff.diff_edges(x, y).collect())
    assert kinds(a, b) == ["added"] and kinds(b, a) == ["removed"] and kinds(a, a) == []


def test_stream_equals_one_batch(spark, tmp_path):
    second = batch("r2", [("Otro", "entity", "Otro"), ("Alta", "process", "Alta")], [("DEPENDS_ON", "Alta", "Otro")])
    (tmp_path / "in").mkdir()
    store, seen = SnapshotStore(spark, str(tmp_path / "store")), []
    for k, b in enumerate((FIRST, second, second)):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(b))
        q = ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check"), after=lambda g: seen.append(1))
        q.awaitTermination()
    whole = import_batch(import_batch(empty_graph(spark), frame(spark, FIRST)).graph, frame(spark, second)).graph
    now = current_graph(store)
    assert len(seen) == 2 and len(store.latest(9)) == 2
    for t, df in whole.tables().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, now.tables()[t].select(*df.columns).collect()))


def test_sections_html_and_candidates(spark):
    docs = spark.createDataFrame([("d", "intro\n# Uno\ntexto\n\n## Vacío\n  \n### Dos\nmás")], "doc_id string, text string")
    assert [(r.section, r.label, r.content) for r in documents.sections(docs).orderBy("section").collect()] == [(0, "0. introducción", "intro"), (1, "1. Uno", "texto"), (3, "3. Dos", "más")]
    manual = spark.createDataFrame([("m", "# Manual\nuno\n## Pagos\n dos \n#### \ntres\n##### cinco")], "doc_id string, text string")
    assert [(r.label, r.content) for r in documents.sections(manual).orderBy("section").collect()] == [("1. Manual", "uno"), ("2. Pagos", "dos"), ("3. ", "tres\n##### cinco")]
    assert documents.titles(docs).head().title == "Uno"
    html = "<h1 class=a>T</h1><p>a &amp;lt; b</p><ul><li>x<li>y</ul><script>no()</script><td>c</td>"
    assert value(spark, documents.html_text(F.lit(html))) == "# T\n\na &lt; b\n\n- x\n- y\n c"
    code = "\n".join(["x"] * 3 + ["if (order.total)"] + ["throw(1)"] * 12 + ["y"])
    files = spark.createDataFrame([("a/b.py", code), ("a/test/b.py", code), ("c.txt", code)], "path string, text string")
    got = [(r.path, r.line_start, r.line_end, r.signals) for r in documents.rule_candidates(files).collect()]
    assert got == [("a/b.py", 2, 12, "conditional-validation"), ("a/b.py", 11, 17, "reject-throw")]
    assert [r.doc_id for r in batches.unique_ids(spark.createDataFrame([("X", 1), ("x 2", 2), ("X", 3), ("X", 4)], "name string, pos int")).orderBy("pos").collect()] == ["x", "x-2", "x-3", "x-4"]
    chunks = batches.chunk(spark.range(10).withColumnRenamed("id", "k"), 4, ["k"])
    assert sorted(len(r.rows) for r in chunks.collect()) == [2, 4, 4]


def whole_graph(spark, monkeypatch):
    """Registered queries over a small graph with an edge of each kind of the projection."""
    from graphloom.plans import queries

    kinds = [("event-e", "TRIGGERS", "process-o"), ("policy-p", "GOVERNS", "process-o"), ("process-o", "DEPENDS_ON", "entity-part-1"), ("role-c", "EXECUTES", "process-o"), ("rule-r", "CALCULATES", "entity-part-1"), ("entity-nation-1", "PART_OF", "entity-region-1")]
    rows = [(f"{k:02d}", a, t, b.split("-")[0] + "/" + b, b, 0.9, "active") for k, (a, t, b) in enumerate(kinds)]
    e = spark.createDataFrame(rows, "id string, source_id string, type string, target_ref string, target_id string, confidence double, status string")
    ids = sorted({x for a, _, b in kinds for x in (a, b)})
    n = spark.createDataFrame([(x, x.split("-")[0], x) for x in ids], "id string, type string, name string")
    monkeypatch.setattr(queries.project, "edges", lambda s, d: e)
    monkeypatch.setattr(queries.project, "nodes", lambda s, d: n)
    return queries.QUERIES, ids


def test_registered_iterations_take_all_edges_and_defaults(spark, monkeypatch):
    queries, ids = whole_graph(spark, monkeypatch)
    seen = []

    def vectors_of(adj, *args, **kw):
        seen.append((edges_of(adj).select("src").distinct().count(), args, kw))
        return edges_of(adj).select(F.col("src").alias("id"), F.array(F.lit(1.0)).alias("vector")).distinct()

    monkeypatch.setattr(iterate, "spectral_embedding", vectors_of)
    monkeypatch.setattr(retrieve, "spectral_embedding", vectors_of)
    monkeypatch.setattr(iterate, "pagerank", lambda seeds, adj, *args, **kw: seen.append((edges_of(adj).select("src").distinct().count(), args, kw)) or seeds.withColumnRenamed("score", "rank"))
    for name in ("pagerank", "spectral_similarity", "similar_nodes"):
        queries[name](spark, "").collect()
    assert seen == [(len(ids), (), {})] * 3


def test_registered_paths_ask_events_to_policies(spark, monkeypatch):
    queries, _ = whole_graph(spark, monkeypatch)
    got = {(r.source, r.target): r.hops for r in queries["k_paths"](spark, "").collect()}
    assert got == {("event-e", "policy-p"): 2, ("entity-nation-1", "entity-region-1"): 1}
