"""The operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickettide.llm import archives, decontamination, html_text, line_dedup, merkle, mixing, ngram_rules, prefix_trie, quality, simhash, token_counts, toxicity, vptree
from tickettide.llm.labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, sf_dir, "pages"))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(quality.FOLDS)
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=part != quality.HELD_OUT)
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", (part == quality.HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("pattern_size").alias("source_size"), F.col("quota").alias("target"), "taken")


def edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(toxicity.FOLDS)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=part != toxicity.HELD_OUT)
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", (part == toxicity.HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def deduped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return line_dedup.dedup_lines(documents)


def ruled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled good; the raw corpus is all of them."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = ngram_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return rows.select("doc_id", *(F.col(f"_{n}").alias(n) for n in names))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_from_arc": archived_pages,
        "op2_benchmark_decontamination": benchmark_hits,
        "op3_quality_classifier": quality_scores,
        "op4_simhash_near_dedup": simhash_groups,
        "op5_source_mixing": source_mix,
        "op6_edit_aware_token_counts": edited_token_counts,
        "op7_vantage_point_search": nearest_vectors,
        "op8_html_text": page_texts,
        "op9_toxicity": toxicity_scores,
        "op10_line_dedup": deduped_lines,
        "op11_ngram_quality_rules": ruled_documents,
        "op12_conversation_prefix_trie": conversation_trie,
        "op13_merkle_manifest": dataset_manifest,
        "pipeline": corpus_pipeline.run,
    }
