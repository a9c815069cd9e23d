"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's
documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.common.store import scope, written
from tidewire.llm import decontam, near_dup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the fixed counts and whose lines are mostly content."""
    crf = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = quality.with_quality(docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]), crf, text_col=f"c{docs.columns.index('text')}")
    return rated.where("quality.kept").select([rated[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shared five-word shingles, from a similarity of 0.8."""
    return near_dup.deduplicate(docs, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that contain no benchmark item."""
    return decontam.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: SQL expresses neither Viterbi decoding nor the search for a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What a stage writes for itself is deleted once its output is written, and the outputs of all stages but the last at the end. A null or empty text has
    no words, so the quality rules drop it; documents without id stay documents of their own; rows that repeat an id and a
    text are near-duplicates, of which one stays; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as whole:
        for name, stage in STAGES:
            with scope(spark) as own:
                docs = own.keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        return whole.keep(docs)
