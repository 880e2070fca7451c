"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark contamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.

Defined results: a null or empty text is judged like any other (it is not toxic, a copy of other texts without words, has no passages and
no tokens); ids may be null or repeated, and of equal texts one row stays; texts of any length are read whole; extra columns are kept up to the last
stage, whatever their names; an empty table of documents gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlstrata.llm import bpe, decontaminate, nearcopies, suffixdedup, toxicity
from crawlstrata.llm.common import stash, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model, keep=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity 0.8) stays; found by op10's search first, then by MinHash bands."""
    return nearcopies.deduplicate(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur more than once go."""
    return suffixdedup.strip_repeated_words(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more stands in passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text that they decode to."""
    return bpe.encode(docs, bpe.default_vocabulary(), ids=True, digests=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("tokenize", tokenize_stage),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
