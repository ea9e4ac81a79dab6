"""Block matrices and similar nodes against dense and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import blockmatrix, retrieve, traversal


def symmetric(seed, n, hub=True):
    rng = random.Random(seed)
    pairs = {(a, rng.randrange(a)) for a in range(1, n) for _ in range(2)} | ({(a, 0) for a in range(1, n)} if hub else set())
    return [(a, b, rng.uniform(0.1, 1)) for a, b in sorted(pairs)]


@pytest.mark.parametrize("nodes,entries", [(20_000, 500_000), (7, 16)])
def test_block_products_and_eigenvectors_equal_dense_ones(spark, monkeypatch, nodes, entries):
    monkeypatch.setattr(blockmatrix, "PART_NODES", nodes)
    monkeypatch.setattr(blockmatrix, "CHUNK_ENTRIES", entries)
    half = symmetric(3, 30)
    both = [(f"n{a:02d}", f"n{b:02d}", w) for a, b, w in half] + [(f"n{b:02d}", f"n{a:02d}", w) for a, b, w in half]
    df = spark.createDataFrame(both, "src string, dst string, a double")
    dense = np.zeros((30, 30))
    for s, t, w in both:
        dense[int(s[1:]), int(t[1:])] = w
    m = blockmatrix.block_matrix(df)
    x0, x1 = m.start(4), None
    x1 = {r.id: r.vector for r in m.rows(m.times(m.times(x0))).collect()}
    x0 = {r.id: r.vector for r in m.rows(x0).collect()}
    order = sorted(x0)
    assert np.allclose(np.array([x1[k] for k in order]), dense @ dense @ np.array([x0[k] for k in order]))
    got = {r.id: np.array(r.vector) for r in blockmatrix.leading_eigenvectors(df, 3, 6, 40).collect()}
    values, vectors = np.linalg.eigh(dense)
    keep = np.argsort(-np.abs(values))[:3]
    want = vectors[:, keep] * np.sqrt(np.abs(values[keep]))
    x = np.stack([got[k] for k in order])
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-3)
    assert blockmatrix.leading_eigenvectors(df.limit(0), 3, 6, 5) is None


def plain_similar(origin, names, weights, spectral, semantic, name_score, limit):
    """weights: node to {neighbour: weight}; name_score: (name, name) to similarity."""
    out = []
    for n in names:
        if n == origin:
            continue
        a, b = weights.get(origin, {}), weights.get(n, {})
        least = sum(min(a[k], b[k]) for k in a if k in b)
        jac = least / (sum(a.values()) + sum(b.values()) - least) if least else 0.0
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
        spec = max(0.0, float(unit(spectral[origin]) @ unit(spectral[n]))) if origin in spectral and n in spectral else 0.0
        rest = 0.35 * (0.6 * jac + 0.4 * spec) + 0.2 * name_score[names[origin], names[n]]
        if origin in semantic and n in semantic:
            score = 0.45 * float(unit(semantic[origin]) @ unit(semantic[n])) + rest
        else:
            score = rest / 0.55
        if score > 0:
            out.append((-round(score, 9), n))
    return [(n, -s) for s, n in sorted(out)[:limit]]


@pytest.mark.parametrize("with_vectors,origins_a_pass", [(True, 1024), (False, 2)])
def test_similar_nodes_equal_a_plain_scan(spark, monkeypatch, with_vectors, origins_a_pass):
    from graphloom.functions.similarity import name_similarity

    monkeypatch.setattr(retrieve, "ORIGINS", origins_a_pass)
    rng = random.Random(11)
    words = ["order", "orders", "client", "invoice", "total", "tax", "line", "x"]
    names = {f"n{k:02d}": " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "!", " é"]) for k in range(60)}
    names["n59"] = ""
    rows = [(f"e{k}", f"n{a:02d}", "DEPENDS_ON", f"n{b:02d}", w) for k, (a, b, w) in enumerate(symmetric(5, 45, hub=False))]
    edges = spark.createDataFrame(rows, "id string, source_id string, type string, target_id string, confidence double")
    weights = {}
    for r in traversal.adjacency(edges).collect():
        own = weights.setdefault(r.src, {})
        own[r.dst] = max(own.get(r.dst, 0), r.weight)
    vec = lambda n: {k: [rng.gauss(0, 1) for _ in range(3)] for k in list(names)[:n]}
    spectral, semantic = vec(45), vec(50) if with_vectors else {}
    table = lambda x: spark.createDataFrame([(k, v) for k, v in x.items()], "id string, vector array<double>")
    nodes = spark.createDataFrame(list(names.items()), "id string, name string")
    distinct = spark.createDataFrame([(n,) for n in sorted(set(names.values()))], "a string")
    score = {(r.a, r.b): r.s for r in distinct.crossJoin(distinct.withColumnRenamed("a", "b")).select("a", "b", name_similarity("a", "b").alias("s")).collect()}
    asked = ["n00", "n07", "n20", "n47", "n58", "n59"]
    origins = spark.createDataFrame([(o,) for o in asked], "origin string")
    got = retrieve.similar_nodes(origins, nodes, edges, table(semantic) if with_vectors else None, 7, table(spectral)).orderBy("origin", "rank").collect()
    for o in asked:
        want = plain_similar(o, names, weights, spectral, semantic, score, 7)
        own = [(r.id, r.score) for r in got if r.origin == o]
        assert [x for x, _ in own] == [x for x, _ in want], o
        assert np.allclose([s for _, s in own], [s for _, s in want], atol=1e-7)


def test_pairs_out_of_reach_are_dropped_where_they_are_read(spark):
    """One node is a twin, the others differ in all that counts: only the twin's name is compared."""
    words = lambda n: [f"w{n}"]
    rows = [(f"n{k}", f"name {k}", chr(97 + k % 20) * 12, words(k), [float(k == 0), 1.0, 0.0] if k < 2 else [0.0, 0.0, 1.0], None) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, name string, n string, words array<string>, spectral array<double>, semantic array<double>")
    asked = df.where("id = 'n0'").collect()
    out = retrieve._near_by_bound(df.coalesce(1), asked, {"n0": 0.15}, 10)
    assert {r.id for r in out.where(F.col("spectral") > 0).collect()} == {"n1"}
    assert out.count() <= 3
