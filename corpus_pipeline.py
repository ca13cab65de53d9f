"""Corpus pipeline: documents to packed training sequences, in five stages.

Every stage gets what its predecessor kept and, but for the last, returns rows with
the columns of documents.  ``run`` writes each stage's result to the shared folder
and reads it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studyspark.llm import decontaminate, packing, quality_crf, simhash_dedup, substring_dedup
from studyspark.llm.common import table, written
from studyspark.llm.registry import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF does not reject; labels of held-out ids are not learned."""
    return quality_crf.kept(docs, quality_crf.fitted(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: SimHash classes of five-word shingles through the byte-position index,
    completed by bands; every link is verified on the sets (similarity 0.8 or more)."""
    return simhash_dedup.one_of_each(docs, shingle=5, similarity=0.8)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without units that an earlier document or place already holds."""
    return substring_dedup.cleaned(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

#: The learned classifier and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
