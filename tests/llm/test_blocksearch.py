"""Ranked search against a plain scan, and the bounds that let blocks be skipped."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import blocksearch, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, limit=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), size in zip(own, sizes):
            m = 100 - 90 + (90 * size * n) // total if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, -1 << 70 if doc is None else doc, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda r: r[:2])[:limit])]
    return sorted(out, key=str)


def zipf_texts(seed, n, longest=80):
    rng = random.Random(seed)
    word = lambda: ["the", "OF", "Ça", "naïve", "x1"][rng.randrange(5)] if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 900}"
    out = [rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(longest))) for _ in range(n)]
    return out + out[: n // 10]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,postings,seeds", [(4, 1_000_000, 200), (2, 300, 3)])
def test_results_equal_a_plain_scan(spark, monkeypatch, block, postings, seeds):
    for name, value in (("BLOCK", block), ("SHARD_POSTINGS", postings), ("SEED_DOCS", seeds)):
        monkeypatch.setattr(blocksearch, name, value)
    texts = zipf_texts(1, 300)
    docs = list(enumerate(texts)) + [(5, None), (None, texts[3]), (7, texts[3]), (7, texts[3]), (900, ""), (901, "the " * 3000)]
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(texts).split()[:12])) for k in range(25)] + [(30, None), (31, ""), (32, "zzz unknown"), (33, "the"), (34, texts[3]), (34, texts[3]), (35, "THE the")]
    got = sorted((tuple(r) for r in blocksearch.search(*frames(spark, docs, items)).collect()), key=str)
    assert got == plain(docs, items)


def test_items_in_several_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocksearch, "ITEM_BYTES", 100)
    texts = zipf_texts(4, 60)
    docs, items = list(enumerate(texts)), [(k, texts[k][:60]) for k in range(12)]
    got = sorted((tuple(r) for r in blocksearch.search(*frames(spark, docs, items), limit=3).collect()), key=str)
    assert got == plain(docs, items, 3)


def test_odd_tables(spark, odd, none):
    docs = odd.select("doc_id", "text", "fp", "rk")
    items = spark.createDataFrame([(1, "words in a row", "x"), (None, "one", "y")], "item_id long, text string, score string")
    got = sorted((tuple(r) for r in blocksearch.search(docs, items).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in odd.collect()], [(1, "words in a row"), (None, "one")])
    assert blocksearch.search(none, items).count() == 0
    assert blocksearch.search(docs, items.where("item_id = 9")).count() == 0
    assert blocksearch.search(docs.where("text is null"), items).count() == 0


def shard_of(rng, rows, vocabulary):
    own = [np.sort(rng.choice(vocabulary, rng.integers(1, 12), replace=False)) for _ in range(rows)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return blocksearch.Shard(pa.array(np.arange(rows)), cuts, np.concatenate(own), rng.integers(1, 1_000_000, cuts[-1]))


def test_no_score_of_a_block_exceeds_its_bound():
    rng = np.random.default_rng(3)
    shard = shard_of(rng, 500, 60)
    weight = rng.integers(0, 9000, 60)
    term, row = shard.postings(blocksearch.similarity_ranks(blocksearch.sketches(shard, weight), 4))
    for t in range(60):
        rows = row[term == t]
        blocked = blocksearch.BlockedList(shard, rows, 60)
        assert sorted(rows) == sorted(np.flatnonzero([t in shard.term[a:b] for a, b in zip(shard.cuts, shard.cuts[1:])]))
        ask = rng.choice(60, 10, replace=False)
        dense = np.zeros(60, np.int64)
        dense[ask] = weight[ask]
        top = np.maximum.reduceat(shard.scores(rows, dense), np.searchsorted(blocked.block, np.arange(len(blocked.summary))))
        bound = blocked.summary[:, ask].astype(np.int64) @ weight[ask]
        assert (top <= bound).all()
        assert (blocked.passing(ask, weight[ask], int(np.median(top))) >= (top >= int(np.median(top)))).all()


def test_blocks_of_alike_documents_are_skipped():
    """Two kinds of documents share one term; an item of the one kind passes over the blocks of the other."""
    rng = np.random.default_rng(5)
    own = [np.concatenate([[0], np.sort(rng.choice(np.arange(1, 20) + 20 * (k % 2), 8, replace=False))]) for k in range(400)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    shard = blocksearch.Shard(pa.array(np.arange(400)), cuts, np.concatenate(own), np.full(cuts[-1], 500_000))
    ask = np.concatenate([[0], np.arange(1, 8)])
    weight = np.where(np.arange(40) == 0, 9000, 1000)
    items = blocksearch.Items(["0"], [ask], [b"%d" % k for k in range(40)], weight, np.full(40, 200), np.full(40, 500_000))
    score = np.sort(shard.scores(np.arange(400), items.dense(0)))
    told = []
    found = list(blocksearch.block_search(shard, items, score[-10:-9], 10, lambda passed, skipped: told.append((passed, skipped))))
    assert sorted(found[0][2]) == score[-10:].tolist()
    assert sum(s for _, s in told) >= 45  # of 100 blocks, half hold documents of the other kind


def test_query_equals_its_sql(spark, tmp_path):
    texts = zipf_texts(8, 150)
    docs, items = frames(spark, list(enumerate(texts)) + [(1, None)], [(k, texts[k]) for k in range(20)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(queries.OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op12_block_search(spark, str(tmp_path)).collect()) == want
