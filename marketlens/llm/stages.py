"""Stages of the corpus pipeline: each applies one operator and returns the documents it keeps."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontaminate as op9
from marketlens.llm import mixing as op2
from marketlens.llm.common import IdSketch, Scratch, read

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def plain_names(stage):
    """Run a stage with other columns under neutral names, so that none clashes with a result's name."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(spark, docs.withColumnsRenamed(neutral), sf_dir)
        return out.withColumnsRenamed({n: c for c, n in neutral.items() if n in out.columns})
    return run


#: Near-duplicates in the pipeline: shingles of five words, similarity 0.8.
STAGE_SHINGLE = 5


@plain_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language stay; null and letterless texts (``und``) and rejected ones go."""
    from marketlens.llm.language_id import identify
    return identify(spark, docs).where("lang_pred <> 'und' and not rejected").select(*docs.columns)


@plain_names
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the kept text; a document whose every line goes stays as an empty text."""
    from marketlens.llm.line_dedup import dedup_lines
    kept = dedup_lines(spark, docs)
    return kept.select(*[
        F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text" else
        F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else
        F.col(c) for c in docs.columns])


@plain_names
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from marketlens.llm.minhash import near_duplicates
    gone = Scratch(spark, "near-dedup").table(
        near_duplicates(spark, docs, shingle=STAGE_SHINGLE).where("not kept").select(F.col("doc_id").alias("extra_gone")).distinct())
    key = F.col("doc_id").cast("long")
    both = IdSketch(gone, "extra_gone").left_join(docs, gone, key == F.col("extra_gone"), key)
    return both.where("extra_gone is null").select(*docs.columns)


@plain_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more of the words go; null and wordless
    texts stay, as does every document where the benchmark is empty."""
    return op9.decontaminate(spark, docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture (input columns named block, slot, pos or on_target are replaced)."""
    return op2.mix_sources(spark, docs)
