"""A training corpus in five stages, each by an operator of sparkloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, mixing, neardup, quality, suffixdedup
from sparkloom.llm.shared import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy prose 2."""
    return quality.keep(docs, ("prose", 2))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, 80 %, as in jaccard_near_dup."""
    return neardup.keep_first(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus."""
    return suffixdedup.rewritten(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order, with the words taken."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("suffix array", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: Cutting bytes can cut a character in two, and DuckDB's SQL has no decoding that drops
#: the rest of one; tests/llm holds run() against a plain re-computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
