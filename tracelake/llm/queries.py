"""The queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import table
from tracelake.llm.conversation_repair import repair_damaged
from tracelake.llm.decontaminate import contamination
from tracelake.llm.jaccard_join import jaccard_components
from tracelake.llm.license_scan import license_scan
from tracelake.llm.line_dedup import line_dedup
from tracelake.llm.mixing import mix_rates
from tracelake.llm.order_minhash import fingerprints
from tracelake.llm.quality_rules import quality_rules
from tracelake.llm.secret_scan import secret_spans, written_spans
from tracelake.llm.source_audit import source_divergence
from tracelake.llm.substring_dedup import substring_dedup
from tracelake.llm.suffix_dedup import suffix_dedup_report
from tracelake.llm.warc import round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_repeated", "n_repeated_chunks", "n_removed", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_rates(table(spark, sf_dir, "documents")).select("doc_id", "_mix.*")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_report(table(spark, sf_dir, "documents"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_warc, op3_decontaminate, op4_jaccard_join, op5_quality_rules, op6_line_dedup, op7_secret_scan, op8_license_scan, op9_mixing, op10_suffix_dedup, op11_order_minhash, op12_source_audit, op13_conversation_repair)
}
