"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``documents`` (the last
stage adds the mixture order).  Each stage applies one corpus operator to all
that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import stages
from marketlens.llm.common import Scratch, read

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("minhash_near_dedup", stages.minhash_near_dedup),
    ("decontaminate", stages.decontaminate),
    ("mix_sources", stages.mix_sources),
]

#: Language ID and MinHash near-dedup cannot be written as SQL; tests/llm compares
#: run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
