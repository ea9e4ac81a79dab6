"""Exact similarity join of labels over an index of rare tokens and rare pieces.

`name_similarity` is the larger of token Jaccard and edit similarity, so a pair of that similarity or more meets in one of these ways:

* equal normal forms;
* tokens: with t the threshold, of n tokens in order of rarity the first n - ceil(t*n) + 1 hold a common one;
* pieces: k = floor((1-t) * length of the longer) edits spoil k pieces at most, if the longer is cut to pieces that don't overlap. So of
  any k+1 of its pieces one stands in the shorter, at a place that is at most k off. The k+1 that are rarest in the other side's
  labels are taken, of the piece length for which they are rarest together.

A token or piece that is common is only looked up where rarer ones don't suffice. Keys that many rows share are split on both sides, so
no task holds more than a bounded number of rows of one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import name_similarity, singular_tokens
from ..functions.text import normalize_text
from ..schemas import GRAY_THRESHOLD
from .shared import cut, split_join

#: Piece lengths that are tried; 1 serves labels for which no other leaves enough pieces.
PIECES = (8, 6, 4, 3, 2)
PAIR = ["a", "b", "label", "label_b"]


def _edits(length: Column, threshold: float) -> Column:
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _side(rows: DataFrame, typed: bool) -> DataFrame:
    """key, t, label, n (normal form), len, words; rows without a normal form are like nothing."""
    t = F.col("type") if typed else F.lit("")
    out = rows.select("key", t.alias("t"), "label", normalize_text("label").alias("n"), singular_tokens("label").alias("words"))
    return cut(out.where("n <> ''").distinct().withColumn("len", F.length("n")), "labels")


def _paired(x: DataFrame, y: DataFrame, on: list[str], test: Column, *more: str) -> DataFrame:
    """Candidate pairs of x (a, label) and y (b, label_b)."""
    own = x.select("*").withColumnRenamed("key", "a")
    other = y.withColumnRenamed("key", "b").withColumnRenamed("label", "label_b").withColumnsRenamed({c: f"{c}_b" for c in more})
    return split_join(own, other, on).where(test).select(*PAIR)


def _by_tokens(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    words = x.select("t", F.explode("words").alias("w")).unionByName(y.select("t", F.explode("words").alias("w")))
    often = cut(words.groupBy("t", "w").agg(F.count("*").alias("f")), "tokens")

    def prefix(side: DataFrame) -> DataFrame:
        each = side.select("key", "t", "label", F.size("words").alias("size"), F.explode("words").alias("w")).join(often, ["t", "w"])
        rare = each.groupBy("key", "t", "label", "size").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("by"))
        first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
        return rare.select("key", "t", "label", "size", F.explode(F.slice("by", F.lit(1), first)).alias("p")).select("key", "t", "label", "size", F.col("p.w").alias("w"))

    fits = F.least("size", "size_b") >= F.greatest("size", "size_b") * threshold - 1e-9
    return _paired(prefix(x), prefix(y), ["t", "w"], fits, "size")


def piece_lengths(threshold: float) -> list[int]:
    """Piece lengths that leave some label enough pieces for one edit or more."""
    enough = lambda q, n: n // q > int(n * (1 - threshold) + 1e-9) >= 1
    return [q for q in PIECES if any(enough(q, n) for n in range(1, 1000))]


def _by_pieces(short: DataFrame, long: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Pairs (a of short, b of long) whose lengths are in that order (strict: and not equal), sharing one of the long label's rarest
    pieces at nearly the same place."""
    k = _edits(F.col("len"), threshold)
    asked = long.select("key", "t", "label", "n", "len").withColumn("k", k).where("k >= 1")
    lengths = F.array(*[F.lit(q) for q in piece_lengths(threshold)]).cast("array<int>")
    fit = F.filter(lengths, lambda q: F.floor(F.col("len") / q) > F.col("k"))
    asked = asked.withColumn("q", F.explode(F.when(F.size(fit) > 0, fit).otherwise(F.array(F.lit(1)))))
    pieces = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / F.col("q")).cast("int") - 1)))
    pieces = pieces.withColumn("pos", (F.col("i") * F.col("q") + 1).cast("int")).withColumn("g", F.col("n").substr(F.col("pos"), F.col("q")))
    qs = F.array(*[F.lit(q) for q in (*piece_lengths(threshold), 1)])
    grams = short.select("key", "t", "label", "n", "len", F.explode(qs).alias("q")).where("len >= q")
    grams = grams.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("q") + 1)))
    grams = grams.select("key", "t", "label", "len", "q", "pos", F.col("n").substr(F.col("pos"), F.col("q")).alias("g"))
    asked_lengths = cut(asked.select("q").distinct(), "lengths")
    grams = grams.join(F.broadcast(asked_lengths), "q", "left_semi")  # six rows at most
    often = cut(grams.groupBy("t", "q", "g").agg(F.count("*").alias("f")), "pieces")
    rated = pieces.select("key", "t", "label", "len", "k", "q", "pos", "g").join(often, ["t", "q", "g"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    own = rated.groupBy("key", "t", "label", "len", "k", "q").agg(F.array_sort(F.collect_list(F.struct("f", "pos", "g"))).alias("by"))
    own = own.withColumn("by", F.slice("by", F.lit(1), F.col("k") + 1))
    cost = F.aggregate("by", F.lit(0).cast("long"), lambda s, p: s + p["f"])
    best = own.groupBy("key", "t", "label", "len", "k").agg(F.min_by(F.struct("q", "by"), F.struct(cost, -F.col("q"))).alias("best"))
    keys = best.select("key", "t", "label", "len", "k", F.col("best.q").alias("q"), F.explode("best.by").alias("p"))
    keys = keys.where("p.f > 0").select("key", "t", "label", "len", "k", "q", F.col("p.pos").alias("pos"), F.col("p.g").alias("g"))
    near = (F.abs(F.col("pos") - F.col("pos_b")) <= F.col("k")) & (F.col("len") >= F.col("len_b") - F.col("k"))
    near &= (F.col("len") < F.col("len_b")) if strict else (F.col("len") <= F.col("len_b"))
    return _paired(grams, keys, ["t", "q", "g"], near, "len", "pos")


def candidates(left: DataFrame, right: DataFrame | None, threshold: float, typed: bool = True) -> DataFrame:
    """left (key, type, label), right the same -> a, b, label, label_b, each once: a superset of the pairs of one type whose labels are
    similar. right=None: pairs a < b of left with itself."""
    x = _side(left, typed)
    y = x if right is None else _side(right, typed)
    if x.isEmpty() or y.isEmpty():
        return left.sparkSession.createDataFrame([], x.select(*[F.col(c).alias(n) for c, n in zip(("key", "key", "label", "label"), PAIR)]).schema)
    equal = _paired(x.select("key", "t", "label", "n"), y.select("key", "t", "label", "n"), ["t", "n"], F.lit(True))
    parts = [equal, _by_tokens(x, y, threshold), _by_pieces(x, y, threshold, False)]
    if right is not None:
        back = _by_pieces(y, x, threshold, True)
        parts.append(back.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("label_b").alias("label"), F.col("label").alias("label_b")))
    pairs = reduce(DataFrame.unionByName, parts)
    if right is None:
        swap = F.col("a") > F.col("b")
        turned = [F.when(swap, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(PAIR, ("b", "a", "label_b", "label"))]
        pairs = pairs.where("a <> b").select(*turned)
    return pairs.distinct()


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float = GRAY_THRESHOLD, typed: bool = True) -> DataFrame:
    """left (a, type, label), right (b, type, label) -> a, b, score: pairs of one type (typed=False: of any) with `name_similarity`
    of at least `threshold` (over all labels of a and b). right=None: pairs a < b within left. No pair is lost."""
    pairs = candidates(left.withColumnRenamed("a", "key"), None if right is None else right.withColumnRenamed("b", "key"), threshold, typed)
    scored = pairs.withColumn("score", name_similarity("label", "label_b")).where(F.col("score") >= threshold)
    return scored.groupBy("a", "b").agg(F.max("score").alias("score"))
