"""Evidence algebra: de-duplication, confidence, conflict, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import evidence_key, short_hash
from ..schemas import BASE_CONFIDENCE, CEILING, SOURCE_BONUS, VALIDATED_CONFIDENCE


def first_evidence(evidence: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order. Later runs and dates don't matter."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return evidence.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def dedup_evidence(evidence: DataFrame, order: Sequence[Column], owner: str = "owner_id") -> DataFrame:
    """First row of each (owner, evidence key) in the given order; adds ev_key."""
    return first_evidence(evidence.withColumn("ev_key", evidence_key()), [owner, "ev_key"], order)


def base_confidence(source_type: Column | str, validated: Column | None = None) -> Column:
    """Hundredths of supporting evidence by its source type; validated interviews count more."""
    source = F.col(source_type) if isinstance(source_type, str) else source_type
    base = F.when((source == "interview") & (F.lit(False) if validated is None else validated), VALIDATED_CONFIDENCE)
    for k, v in BASE_CONFIDENCE.items():
        base = base.when(source == k, v)
    return base


def score_edges(evidence: DataFrame, keys: Sequence[str], more: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """keys, confidence, status (conflicted or active), n_evidence of de-duplicated evidence. Conflicted: some evidence supports, some
    contradicts, and not all of it has one source type and locator.

    Sums by source type and then over them, so no count of distinct values multiplies the rows, and evidence that is dealt by some of
    the keys isn't exchanged. more: further columns by name, each an aggregate over evidence and one over the column of that name."""
    more = more or {}
    supports, source = F.col("stance") == "supports", F.col("source_type")
    base = base_confidence(source, F.col("validated_by").isNotNull())
    by_type = evidence.groupBy(*keys, "source_type").agg(
        F.max(F.when(supports, base)).alias("_base"), F.max(supports).alias("_for"), F.max(F.col("stance") == "contradicts").alias("_against"),
        F.min("locator").alias("_least"), F.max("locator").alias("_most"), F.count("locator").alias("_placed"), F.count("*").alias("_n"),
        *[first.alias(name) for name, (first, _) in more.items()],
    )
    kinds = F.count_if(F.col("_for") & source.isNotNull())
    places = (F.count("*") > 1) | (F.min("_least") != F.max("_most")) | (F.sum("_placed").between(1, F.sum("_n") - 1))
    hundredths = F.least(F.lit(CEILING), F.coalesce(F.max("_base") + SOURCE_BONUS * (kinds - 1), F.lit(0)))  # least() passes over nulls
    clash = F.coalesce(F.max("_for") & F.max("_against") & F.coalesce(places, F.lit(False)), F.lit(False))
    status = F.when(clash, "conflicted").otherwise("active")
    return by_type.groupBy(*keys).agg((hundredths / 100.0).alias("confidence"), status.alias("status"), F.sum("_n").alias("n_evidence"), *[then.alias(name) for name, (_, then) in more.items()])


def set_hash() -> Column:
    """Twelve hex digits of a group's sorted evidence keys (ev_key)."""
    return hash_of(F.collect_list("ev_key"))


def hash_of(keys: Column) -> Column:
    """The same of an array of keys."""
    return short_hash(F.array_join(F.array_sort(keys), "\n"))


def evidence_set_hash(evidence: DataFrame, owner: str = "owner_id") -> DataFrame:
    """owner, evidence_set: twelve hex digits of the sorted evidence keys."""
    keyed = evidence if "ev_key" in evidence.columns else evidence.withColumn("ev_key", evidence_key())
    return keyed.groupBy(owner).agg(set_hash().alias("evidence_set"))


def conflict_report(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Conflicted edges with the keys of their supporting and contradicting evidence."""
    own = evidence.join(edges.where("status = 'conflicted'").select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("stance") == s, short_hash("ev_key"))))
    return own.groupBy("owner_id").agg(side("supports").alias("supporting"), side("contradicts").alias("contradicting")).select(F.concat(F.lit("conflict-"), F.substring(F.sha1("owner_id"), 1, 12)).alias("conflict_id"), F.col("owner_id").alias("edge_id"), "supporting", "contradicting")


def recompute_status(edges: DataFrame, sets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """edges (id, status, clash), sets (owner_id, evidence_set), resolutions (edge_id, status, evidence_set) -> edges with
    new_status. A resolution of the present set holds; a stale one leaves what else deprecated an edge deprecated, and
    otherwise the evidence decides; without one, deprecated stays and the evidence decides the rest."""
    r = resolutions.select(F.col("edge_id").alias("id"), F.col("status").alias("r_status"), F.col("evidence_set").alias("r_set"))
    joined = edges.join(sets.withColumnRenamed("owner_id", "id"), "id", "left").join(r, "id", "left")
    tested = F.when(F.col("clash"), "conflicted").otherwise("active")
    deprecated = F.col("status") == "deprecated"
    new = (
        F.when(F.col("r_set").eqNullSafe(F.col("evidence_set")) & F.col("r_status").isNotNull(), F.col("r_status"))
        .when(F.col("r_status").isNotNull() & deprecated & (F.col("r_status") != "deprecated"), "deprecated")
        .when(F.col("r_status").isNull() & deprecated, "deprecated").otherwise(tested)
    )
    return joined.withColumn("new_status", new).drop("r_status", "r_set", "evidence_set")


def well_formed_resolutions(resolutions: DataFrame) -> DataFrame:
    """Rows whose winner and evidence_set are there and whose status is active or deprecated."""
    return resolutions.where("winner is not null and evidence_set is not null and status in ('active', 'deprecated')")
