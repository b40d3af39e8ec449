"""Registered queries of the corpus operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import read


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.url_filter import rule_table, url_filter
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.mixing import mix_sources
    return mix_sources(spark, read(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.decontaminate import decontaminate, items_digest
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        items_digest(F.col("items")).alias("items_sha256"), "contaminated",
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m.n_words)), F.lit(0)).cast("long").alias("longest_match"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.toxicity import score_toxicity
    return score_toxicity(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.language_id import identify
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(spark, docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.quality import score_quality
    return score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.line_dedup import dedup_lines
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs, with_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.substring_dedup import repeated_spans
    return repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("t")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.minhash import near_duplicates
    return near_duplicates(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.embeddings import near_vectors
    return near_vectors(spark, read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.common import Scratch
    from marketlens.llm.simhash import near_counts, neighbour_fingerprints
    rows = Scratch(spark, "fingerprints").table(neighbour_fingerprints(spark, read(spark, sf_dir, "documents").select("doc_id", "text")))
    return near_counts(rows, F.col("doc_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.common import Scratch
    from marketlens.llm.ranked_search import build_index, search
    index = Scratch(spark, "search-index").table(build_index(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return search(spark, index, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.merkle import changed_copy, fold, hex_text, merkle_manifest, proof_bytes
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle_manifest(spark, docs, claim=changed_copy)
    found = found.withColumn("folded", fold(F.col("claimed"), F.col("path")))
    return found.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
                        hex_text(F.col("root")).alias("root"), F.sha2(hex_text(proof_bytes(F.col("path"))), 256).alias("proof_sha256"),
                        hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_mix_sources, op3_toxicity, op4_language_id, op5_quality, op6_line_dedup, op7_minhash,
    op8_embedding_dedup, op9_decontaminate, op10_substring_dedup, op11_fingerprints,
    op12_ranked_search, op13_merkle_manifest)}
