"""Registered queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocksearch, containment, hilbert, langid, linededup, packing, periodic, quality, rindex, secrets, simhash, sstable, tokencount
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json", variable: str = "GRAPHLOOM_TOKENIZER") -> str:
    """The public vocabulary's file; the environment variable names another."""
    if found := os.environ.get(variable):
        return found
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"))


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rindex.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32(F.array_join("ids", ",").cast("binary"))).drop("ids")


def op7_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"))


def op9_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_to_shards(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json", "GRAPHLOOM_BYTE_TOKENIZER"))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocksearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH terms AS (
  SELECT row_key, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_key, doc_id, text FROM documents)),
asked AS (
  SELECT DISTINCT item_key, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item_key, item_id, text FROM benchmark)),
sizes AS (SELECT row_key, count(*) AS n FROM terms GROUP BY row_key),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
found AS (SELECT row_key, doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), whole),
impacts AS (
  SELECT row_key, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)) AS impact
  FROM found JOIN sizes USING (row_key), whole),
scores AS (
  SELECT item_key, item_id, row_key, doc_id, sum(w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING sum(w * impact) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id::BIGINT AS doc_id, score FROM ranked WHERE rank <= 10
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents' ids and texts; of those whose id's crc32 h is divisible by 10, word i >= a becomes word a+(i-a)%p, where
    a=g%n, p=1+floor((n-a)/(3+g%8)), g=floor(h/10), n words. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    picked = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")))
    n = F.size("w")
    picked = picked.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    picked = picked.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", F.col("a") + (i - F.col("a")) % F.col("p") + 1)))
    return picked.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    order = "array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN sign(y.length - x.length) WHEN x.start <> y.start THEN sign(x.start - y.start) ELSE sign(x.period - y.period) END::int)"
    best = F.try_element_at(F.expr(order), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_importance_resampling, op2_run_length_index, op3_benchmark_containment, op4_language_mixture, op5_simhash_near_dedup, op6_best_fit_packing, op7_randomness_secrets, op8_hilbert_neighbours, op9_sorted_string_table, op10_line_set_similarity, op11_whole_token_counts, op12_block_search, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op12_block_search": OP12_SQL}
