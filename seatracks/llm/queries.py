"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, language_id, licenses, line_dedup, lm_scoring, mixing, neighbours, packing, prefix_trie, quality_rules, simhash, sql, toxicity, warc
from .common import table


def held_out(divisor: int, remainder: int):
    """True for the documents that a model must not learn from; null without an id, which teaches nothing either."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its source's directory (ids divisible by 10) or of one of that directory's nine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    inner = F.when(F.col("doc_id") % 10 != 0, (F.col("doc_id") % 10).cast("string"))
    return licenses.scan(docs, "doc_id", F.concat_ws("/", "source", inner, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(4, 2), F.lit(False)))
    model = language_id.fit(docs.where(~held_out(4, 2)))
    return language_id.predict(docs, model, ("doc_id", "held_out"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality_rules.judged(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(3, 1), F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    return toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id", "held_out"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_license_scan,
        op2_language_id,
        op3_simhash,
        op4_warc,
        op5_quality_rules,
        op6_packing,
        op7_mixing,
        op8_lm_scoring,
        op9_toxicity,
        op10_neighbours,
        op11_line_dedup,
        op12_prefix_trie,
        op13_filter_audit,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
