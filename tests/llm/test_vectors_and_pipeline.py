import random

import numpy as np

from graphloom.llm import containment, hilbert, simhash
from graphloom.llm.queries import ORACLES, QUERIES


def exact(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j) for j, w in good if j != i)
            out[i] = [j for _, j in found[:k]]
    return out


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(hilbert.nearest(df, block_rows=60).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_nearest_with_copies_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [1.0, 0.5, 0.0]) for k in range(0, 70)] + [(100 + k, [rng.random() - 0.5 for _ in range(3)]) for k in range(30)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    bad = [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 0.0]), (460, [float("nan"), 0.0, 1.0]), (480, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0]), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(hilbert.nearest(df, window=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, 20, 20)
    assert hilbert.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:1] + rows[70:75], "vec_id long, embedding array<float>")
    assert len({r.vec_id for r in hilbert.nearest(few).where("query_id = 0").collect()}) == 5


def test_hilbert_index_is_a_curve():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert.hilbert_index(grid, bits)
        assert sorted(place) == list(range(side**dims))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item = say(20)
    line = say(12)
    good = [(k, say(60) + "\n" + say(40)) for k in range(120)]
    good[5] = (5, good[5][1] + " " + item)
    good[7] = (7, good[7][1] + "\n" + line)
    good[8] = (8, good[8][1] + "\n" + line)
    good += [(200, good[9][1]), (201, None), (202, "")]
    bad = [(300 + k, " ".join(w + "!!" for w in say(60).upper().split())) for k in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in good + bad], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, t in good + bad if t], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    here, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, here, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        here = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(p.STAGES) - 1:
            assert here.columns == docs.columns
        seen.append({r.doc_id: r for r in here.collect()})
    assert {i for i in seen[0] if i < 300} >= {i for i, _ in good if i < 200} and not [i for i in seen[0] if i >= 300]
    assert seen[1].keys() == seen[0].keys() - {200} and seen[1][8].text == good[8][1].rsplit("\n", 1)[0] and seen[1][7].text == good[7][1]
    assert seen[1][201].text is None and seen[1][202].text == ""
    assert seen[2].keys() == seen[1].keys() - {202} and 9 in seen[2]  # texts without words are alike
    assert 5 not in seen[3] and len(seen[3]) == len(seen[2]) - 1
    assert seen[4].keys() == seen[3].keys()
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == set(seen[4])


def test_near_copies_of_similarity_08_go(spark):
    rng = random.Random(14)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for n in [1, 3, 5, 6, 20, 60, 100, 200, 300, 500]:
        base = say(n)
        rows.append(base)
        for edits in (0, 1, 2, 3, 5, 8, 12):
            w = list(rows[-1] if edits % 2 else base)
            for _ in range(edits):
                w[rng.randrange(n)] = "changed%d" % rng.randrange(1000)
            rows.append([x.upper() for x in w] if edits == 3 else w)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, ""), (901, None), (902, " \t"), (None, "only without an id here"), (5, "one more row of an id"), (5, "one more row of an id")]

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    own, part = [sets(t) for _, t in rows], list(range(len(rows)))
    raw = [(t or "").encode() for _, t in rows]
    fp = [int(simhash.fingerprints(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5)[0]) for t in raw]
    for a in range(len(rows)):
        for b in range(a):
            near = len(own[a] & own[b]) * 5 >= len(own[a] | own[b]) * 4 or (fp[a] ^ fp[b]).bit_count() <= 4
            if near and part[a] != part[b]:
                part = [part[b] if x == part[a] else x for x in part]
    want, seen = [], set()
    for k in order:
        if part[k] not in seen:
            seen.add(part[k])
            want.append(rows[k])
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str) and len(want) < len(rows) - 20
    assert simhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string"), similarity=0.8).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids in every stage, repeated rows, and tables without rows."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that stand here in a row and are long enough"
    rows = [(None, text, None, None, None), (None, text, None, None, None), (3, None, "en", "s", 0), (4, text + " and quite a few more of them besides", "en", "s", 3)]
    for name, own in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(7, None)] if own else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = p.run(spark, at).collect()
        assert {r.doc_id for r in got} == ({None, 3, 4} if own else set())


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    for n in (2, 22, 60):
        rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(rng.standard_normal((n, 8)))]
        got = {}
        for r in sorted(hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {q: len(v) for q, v in got.items()} == {q: min(20, n - 1) for q in range(0, n, 20)}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as p

    names = ["log_weight", "sample_key", "n_lines", "n_removed", "_leaks", "leaks", "row", "rk", "gone", "h", "fp", "a.b"]
    text = "some words that stand here in a row and are long enough"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(k, f"{text} number {k} and more of them", "en", "s", 3, *[f"{n}{k}" for n in names]) for k in range(3)]
    docs, at = spark.createDataFrame(rows, schema), str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, "quite another item of five words")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
    assert containment.decontaminate(docs.drop("a.b"), spark.read.parquet(f"{at}/benchmark.parquet")).where("`_leaks` is not null").count() == 3
