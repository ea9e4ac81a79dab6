"""Corpus pipeline: quality, line de-duplication, near-de-duplication, decontamination, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import containment, linededup, packing, quality, simhash
from graphloom.llm.common import materialise, table


OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def with_own_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with columns that documents has beside its usual ones under other names meanwhile: operators replace columns of the
    names that they add."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"_own_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run_stage


@with_own_columns
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes."""
    return quality.importance_resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


@with_own_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that match an earlier line; n_chars follows.

    A document goes if these were all its lines with words: nothing is left of it but blanks. One that had no words to begin
    with stays.
    """
    out = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t\x0b\x0c", " " * 5)) == "")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~emptied | F.col("text").isNull()).withColumn("n_chars", chars).select(*docs.columns)


@with_own_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Shingles of five words; fingerprints that
    differ in four of their 64 bits at most."""
    return simhash.drop_near_duplicates(docs)


@with_own_columns
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' token ids."""
    return packing.best_fit_packing(docs)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near-duplicates", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Resampling and best-fit packing can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
