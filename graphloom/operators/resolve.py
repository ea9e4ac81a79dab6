"""Entity resolution: exact keys, blocked similarity joins, in-batch grouping, new identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import node_id_for
from ..functions.similarity import round4
from ..functions.text import match_keys
from ..schemas import AUTO_THRESHOLD, GRAY_THRESHOLD
from .shared import cut
from .simjoin import similar_pairs


def names_of(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, type, label: names and aliases of nodes."""
    own = nodes.select("id", "type", F.col("name").alias("label"))
    if aliases is not None:
        own = own.unionByName(aliases.join(nodes.select("id", "type"), F.col("node_id") == F.col("id")).select("id", "type", F.col("alias").alias("label")))
    return own.where("label is not null").distinct()


def exact_matches(mentions: DataFrame, labels: DataFrame, typed: bool = True) -> DataFrame:
    """mentions (mention_id, type, mention) -> mention_id, node_id: the smallest id of a node (of the same type) with a common
    match key."""
    m = mentions.select("mention_id", "type", F.explode(match_keys("mention")).alias("key")).where("key <> ''")
    on = ["type", "key"] if typed else ["key"]
    n = labels.select(F.col("id").alias("node_id"), "type", F.explode(match_keys("label")).alias("key")).where("key <> ''").groupBy(*on).agg(F.min("node_id").alias("node_id"))
    return m.join(n, on).groupBy("mention_id").agg(F.min("node_id").alias("node_id"))


def duplicate_audit(nodes: DataFrame, aliases: DataFrame | None = None, linked: DataFrame | None = None, threshold: float = GRAY_THRESHOLD) -> DataFrame:
    """Pairs of nodes of one type (a < b) whose names or aliases are similar and that no proposal or merge links (a, b)."""
    labels = names_of(nodes, aliases)
    pairs = similar_pairs(labels.withColumnRenamed("id", "a"), None, threshold)
    if linked is not None:
        both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = pairs.join(both, ["a", "b"], "left_anti")
    return pairs.select("a", "b", round4("score").alias("score"))


def best_matches(mentions: DataFrame, labels: DataFrame, threshold: float = GRAY_THRESHOLD, typed: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """mention_id, node_id, score: the most similar node of each mention; ties to the smaller id. vectors (mention_id, node_id,
    score) adds calibrated vector similarities of neighbours found elsewhere."""
    m = mentions.select(F.col("mention_id").alias("a"), "type", F.col("mention").alias("label"))
    pairs = similar_pairs(m, labels.withColumnRenamed("id", "b"), threshold, typed).select(F.col("a").alias("mention_id"), F.col("b").alias("node_id"), "score")
    if vectors is not None:
        pairs = pairs.unionByName(vectors.where(F.col("score") >= threshold)).groupBy("mention_id", "node_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("mention_id").orderBy(F.desc("score"), "node_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def group_in_batch(mentions: DataFrame, fuzzy: DataFrame, auto: float = AUTO_THRESHOLD) -> DataFrame:
    """mentions (run_id, mention_id, pos, type, mention) without an exact match in the store -> mention_id, creator (the
    mention whose node it joins; its own for creators; null where the store node of `fuzzy` takes it).

    As if taken one by one: a mention joins the earliest creator of its type that shares a match key; else the store node
    that it resembles to `auto` or more takes it; else it creates a node. Mentions and keys are a bipartite graph over which two
    minima travel each round: a key's earliest creator, and its earliest mention that may yet become one (open; not one that the
    store would take). A mention joins a creator that stands before all open ones, and settles alone if it has neither. So rounds
    follow the longest chain of such mentions, and each is linear in mentions and keys, however many share a key."""
    by = ["run_id", "type", "key"]
    taken = fuzzy.where(F.col("score") >= auto).select("mention_id", F.lit(True).alias("stored"))
    state = mentions.select("mention_id").join(taken, "mention_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    state = cut(state.select("mention_id", "stored", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("creator")), "state")
    keys = cut(mentions.select("run_id", "mention_id", "pos", "type", F.explode(match_keys("mention")).alias("key")).where("key <> ''"), "keys")
    while True:
        open_ = F.col("outcome").isNull() & ~F.col("stored")
        least = keys.join(state, "mention_id").groupBy(*by).agg(
            F.min(F.when(F.col("outcome") == "created", F.struct(F.col("pos").alias("at"), F.col("mention_id").alias("who")))).alias("made"),
            F.min(F.when(open_, F.col("pos"))).alias("open"),
        )
        waiting = keys.join(state.where("outcome is null").select("mention_id"), "mention_id", "left_semi")
        near = waiting.join(least, by).groupBy("mention_id").agg(
            F.min(F.when(F.col("made.at") < F.col("pos"), F.col("made"))).alias("first"),
            F.min(F.when(F.col("open") < F.col("pos"), F.col("open"))).alias("open"),
        )
        s = state.join(near, "mention_id", "left")
        joins = F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("first.at")))
        alone = F.col("first").isNull() & F.col("open").isNull()
        outcome = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(joins, "joined").when(alone & F.col("stored"), "stored").when(alone, "created")
        creator = F.when(F.col("outcome").isNotNull(), F.col("creator")).when(joins, F.col("first.who")).when(alone & ~F.col("stored"), F.col("mention_id"))
        state = cut(s.select("mention_id", "stored", outcome.alias("outcome"), creator.alias("creator")), "state")
        if state.where("outcome is null").isEmpty():
            return state.select("mention_id", "outcome", "creator")


def suffixed_ids(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (key, base, pos) with taken (id) -> key, id: base, base-2, base-3, ... in order of pos, passing over taken ids and
    plain bases of other new rows."""
    plain = cut(new.select("key", "base", "pos"), "bases")
    used = taken.select("id").distinct()
    w = W.partitionBy("base").orderBy("pos", "key")
    rows = plain.withColumn("n", F.row_number().over(w)).join(used.select(F.col("id").alias("base"), F.lit(1).alias("hit")), "base", "left").withColumn("n", F.col("n") + F.coalesce("hit", F.lit(0)))
    # numbers that are taken for each base, from the store and from other plain bases
    first = plain.select(F.col("base").alias("id")).distinct()
    tails = used.unionByName(first).select(F.regexp_extract("id", r"^(.*)-(\d{1,9})$", 1).alias("base"), F.regexp_extract("id", r"-(\d{1,9})$", 1).try_cast("int").alias("k")).where("k >= 2").groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("skip"))
    rows = rows.join(tails, "base", "left")
    n = F.aggregate(F.coalesce("skip", F.array().cast("array<int>")), F.col("n"), lambda a, k: F.when((a >= 2) & (k <= a), a + 1).otherwise(a))
    return rows.select("key", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("id"))


def resolve(batch: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, auto: float = AUTO_THRESHOLD, gray: float = GRAY_THRESHOLD, key: str = "mention", vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """batch nodes (run_id, pos, mention, candidate_id, type, name) -> (resolutions, merge proposals).

    resolutions: run_id, mention, type, action (candidate, exact, batch, fuzzy, provisional, new), node_id, score. In order: a
    candidate id that exists with the type; an exact key in the store; an earlier new node of the batch; a store node similar to
    `auto` or more; one of `gray` or more gives a provisional node and a proposal; else a new node. key="mention": decisions
    hold for a mention whatever its type, the first node's; "mention,type": for each pair."""
    rows = batch.select("run_id", "pos", "mention", "candidate_id", "type", "name")
    by = ["run_id", "mention"] + (["type"] if key == "mention,type" else [])
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("pos"))).where("_n = 1").drop("_n")
    rows = cut(rows.withColumn("mention_id", F.concat_ws("#", "run_id", F.format_string("%09d", F.col("pos").cast("int")))), "mentions")
    given = rows.join(nodes.select(F.col("id").alias("candidate_id"), "type"), ["candidate_id", "type"], "left_semi").select("mention_id", F.col("candidate_id").alias("node_id"), F.lit("candidate").alias("action"), F.lit(1.0).alias("score"))
    labels = cut(names_of(nodes, aliases), "labels")
    rest = rows.join(given, "mention_id", "left_anti")
    exact = exact_matches(rest, labels).select("mention_id", "node_id", F.lit("exact").alias("action"), F.lit(1.0).alias("score"))
    exact = cut(exact, "exact")
    rest = cut(rest.join(exact, "mention_id", "left_anti"), "rest")
    fuzzy = cut(best_matches(rest, labels, gray, vectors=vectors), "fuzzy")
    state = cut(group_in_batch(rest, fuzzy, auto), "grouped")
    stored = state.where("outcome = 'stored'").join(fuzzy, "mention_id").select("mention_id", "node_id", F.lit("fuzzy").alias("action"), "score")
    makers = state.where("outcome = 'created'").join(rest, "mention_id")
    ids = suffixed_ids(makers.select(F.col("mention_id").alias("key"), node_id_for("type", "name").alias("base"), "mention_id").withColumnRenamed("mention_id", "pos"), nodes)
    ids = cut(ids.select(F.col("key").alias("creator"), F.col("id").alias("node_id")), "ids")
    made = state.where("outcome = 'created'").join(ids, "creator").join(fuzzy.select("mention_id", F.col("score").alias("gray_score")), "mention_id", "left")
    made = made.select("mention_id", "node_id", F.when(F.col("gray_score").isNotNull(), "provisional").otherwise("new").alias("action"), F.coalesce("gray_score", F.lit(0.0)).alias("score"))
    joined = state.where("outcome = 'joined'").join(ids, "creator").select("mention_id", "node_id", F.lit("batch").alias("action"), F.lit(1.0).alias("score"))
    every = reduce(DataFrame.unionByName, [given, exact, stored, made, joined])
    out = cut(rows.join(every, "mention_id").select("run_id", "pos", "mention", "type", "action", "node_id", round4("score").alias("score"), "mention_id"), "resolutions")
    target = fuzzy.select("mention_id", F.col("node_id").alias("target"))
    proposals = out.where("action = 'provisional'").join(target, "mention_id").select(F.substring(F.sha1(F.concat_ws("|", "mention", "target", "run_id")), 1, 12).alias("id"), "run_id", "mention", F.col("node_id").alias("source"), "target", "score", F.lit("pending").alias("status"))
    return out.drop("mention_id"), proposals


def resolve_edge_mentions(edges: DataFrame, resolutions: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, auto: float = AUTO_THRESHOLD) -> DataFrame:
    """run_id, mention, node_id, action of edge ends that no node of the batch covers: any type, exact or `auto` similar; else a
    new entity."""
    ends = edges.select("run_id", F.col("source_mention").alias("mention")).unionByName(edges.select("run_id", F.col("target_mention").alias("mention"))).distinct()
    bare = ends.join(resolutions.select("run_id", "mention"), ["run_id", "mention"], "left_anti").withColumn("mention_id", F.concat_ws("#", "run_id", "mention")).withColumn("type", F.lit("entity"))
    bare, labels = cut(bare, "bare"), names_of(nodes, aliases)
    exact = cut(exact_matches(bare, labels, typed=False), "exact")
    rest = bare.join(exact, "mention_id", "left_anti")
    fuzzy = cut(best_matches(rest, labels, auto, typed=False).select("mention_id", "node_id"), "fuzzy")
    new = rest.join(fuzzy, "mention_id", "left_anti")
    ids = suffixed_ids(new.select(F.col("mention_id").alias("key"), node_id_for("type", "mention").alias("base"), F.col("mention_id").alias("pos")), nodes).select(F.col("key").alias("mention_id"), F.col("id").alias("node_id"))
    found = exact.withColumn("action", F.lit("exact")).unionByName(fuzzy.withColumn("action", F.lit("fuzzy"))).unionByName(ids.withColumn("action", F.lit("new")))
    return bare.join(found, "mention_id").select("run_id", "mention", "node_id", "action")
