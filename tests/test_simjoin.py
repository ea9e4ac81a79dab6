"""The similarity join against all pairs, and how many candidates it compares."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.similarity import name_similarity
from graphloom.operators import shared, simjoin


def noisy(rng, text):
    out = list(text)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randrange(2)] = rng.choice(["", "x", "é", " "])
    return "".join(out)


def labels(seed, n):
    rng = random.Random(seed)
    words = ["order", "orders", "client", "invoice", "ab", "a", "company", "Ünit", "tax-line"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)] + ["", " ! ", "a", "b", "ab", "abc", "abd", "abcd", "abce", "xbcd"]
    return [(f"{k:03d}", rng.choice("et"), noisy(rng, t)) for k, t in enumerate(base)]


def plain(spark, left, right, threshold, typed=True):
    pairs = left.withColumnRenamed("type", "ta").crossJoin(right.select("b", F.col("type").alias("tb"), F.col("label").alias("lb")))
    pairs = pairs.where("ta = tb") if typed else pairs
    empty = (F.trim(F.regexp_replace("label", r"[^\p{L}\p{N}]", "")) == "") | (F.trim(F.regexp_replace("lb", r"[^\p{L}\p{N}]", "")) == "")
    scored = pairs.where(~empty).withColumn("s", name_similarity("label", "lb")).where(F.col("s") >= threshold)
    return {(r.a, r.b): round(r.s, 9) for r in scored.groupBy("a", "b").agg(F.max("s").alias("s")).collect()}


@pytest.mark.parametrize("threshold,typed,hot", [(0.75, True, 20_000), (0.75, False, 3), (0.92, True, 20_000), (0.5, True, 20_000)])
def test_no_pair_is_lost(spark, monkeypatch, threshold, typed, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    left = spark.createDataFrame(labels(1, 60), "a string, type string, label string")
    right = spark.createDataFrame(labels(2, 50) + labels(1, 5), "b string, type string, label string")
    got = {(r.a, r.b): round(r.score, 9) for r in simjoin.similar_pairs(left, right, threshold, typed).collect()}
    assert got == plain(spark, left, right, threshold, typed)


def test_pairs_within_one_side(spark):
    left = spark.createDataFrame(labels(3, 70), "a string, type string, label string")
    want = {p: s for p, s in plain(spark, left, left.withColumnRenamed("a", "b"), 0.75).items() if p[0] < p[1]}
    assert {(r.a, r.b): round(r.score, 9) for r in simjoin.similar_pairs(left, None, 0.75).collect()} == want


def test_odd_sides(spark):
    none = spark.createDataFrame([], "a string, type string, label string")
    some = spark.createDataFrame([("1", "e", None), ("2", None, "order"), ("3", "e", "order"), ("3", "e", "order")], "b string, type string, label string")
    assert simjoin.similar_pairs(none, some, 0.75).count() == 0
    assert {(r.a, r.b) for r in simjoin.similar_pairs(some.withColumnRenamed("b", "a"), some, 0.75).collect()} == {("3", "3")}


def test_candidates_grow_with_the_rows_when_one_word_is_in_all_names(spark):
    """Names of four rare words and a common one: candidates stay near the number of rows, not near its square."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    count = {}
    rows = [(f"{k}", "e", " ".join([word(), word(), "co", word(), word()])) for k in range(1200)]
    for n in (300, 1200):
        df = spark.createDataFrame(rows[:n], "key string, type string, label string")
        count[n] = simjoin.candidates(df, None, 0.92).count()
    assert count[1200] <= 1200 and count[1200] <= 8 * max(count[300], 30)


def test_split_join_equals_the_plain_one(spark):
    rng = random.Random(4)
    x = spark.createDataFrame([(rng.choice("aaaaab"), k) for k in range(200)] + [(None, 1)], "k string, x int")
    y = spark.createDataFrame([(rng.choice("aaabc"), k) for k in range(90)], "k string, y int")
    got = shared.split_join(x, y, ["k"], 7)
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, x.join(y, "k").select("k", "x", "y").collect()))
