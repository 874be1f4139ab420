"""The corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last one returns pieces of training sequences with their ids.

Defined results: documents with a null or empty text are rejected by the classifier, so later stages never see them; null ids, languages and sources are carried. Of equal rows, and of texts of one group of near-duplicates, the one of the smallest doc_id stays (null ids last).
Texts of any length are read whole. Columns of any names and number are carried to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequarry.llm import common, kneser_ney, packing, quality_rules, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted texts' model is below their language's threshold."""
    return kneser_ney.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001 - a stage's signature
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group of near-duplicates (0.8 of five-word shingles or more)."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Sequences of at most 2048 ids, a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("near-duplicates", near_duplicates), ("packing", pack)]

#: SQL expresses neither the classifier nor the fingerprints; tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            common.drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
