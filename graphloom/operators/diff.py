"""Drift: what two graph states differ in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (id, name, status, description, aliases array, attrs) -> id, kind (added, removed, changed), fields. Aliases are
    compared as sets; edges don't count."""
    fields = ("name", "status", "description", "aliases", "attrs")

    def side(df: DataFrame, p: str) -> DataFrame:
        own = {"aliases": F.array_sort(F.array_distinct(F.coalesce("aliases", F.array().cast("array<string>"))))}
        return df.select("id", F.struct(*[own.get(f, F.col(f)).alias(f) for f in fields]).alias(p))

    j = side(a, "a").join(side(b, "b"), "id", "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select("id", kind.alias("kind"), F.when(kind == "changed", F.array_join(changed, ",")).alias("fields")).where("kind is not null")


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """By (source, type, target): kind, and confidence and status before and after; changed if either is."""
    keys = ["source_id", "type", "target_ref"]
    side = lambda df, p: df.select(*keys, F.col("confidence").alias(f"{p}_confidence"), F.col("status").alias(f"{p}_status"))
    j = side(a, "before").join(side(b, "after"), keys, "full")
    same = F.col("before_confidence").eqNullSafe(F.col("after_confidence")) & F.col("before_status").eqNullSafe(F.col("after_status"))
    kind = F.when(F.col("before_status").isNull(), "added").when(F.col("after_status").isNull(), "removed").when(~same, "changed")
    return j.withColumn("kind", kind).where("kind is not null")


def diff_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """element, kind, n."""
    rows = nodes.select(F.lit("node").alias("element"), "kind").unionByName(edges.select(F.lit("edge").alias("element"), "kind"))
    return rows.groupBy("element", "kind").agg(F.count("*").alias("n"))


def diff_working(store, staging: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame] | None:
    """Node and edge changes of unpublished tables against the newest version; nothing without one."""
    newest = store.latest(1)
    if not newest:
        return None
    return diff_nodes(store.load("nodes", newest[0]), staging["nodes"]), diff_edges(store.load("edges", newest[0]), staging["edges"])
