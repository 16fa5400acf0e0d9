"""The corpus pipeline: five stages over the documents, each written and read again.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null keys, null and empty texts and repeated rows are handled as the
operators' docstrings say; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontam, langid, line_dedup, mixing, near_dup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go (null, without a letter, or unlike any language)."""
    return langid.accepted_rows(docs, langid.language_models(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts freed of lines that five or more sources hold, but for one holder; ``op2`` keeps its own ten."""
    return line_dedup.without_boilerplate(docs, min_sites=5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Links are at a similarity of 0.8 or more of five-word shingles; ``op7`` keeps its own 0.85. With
    34 bands of 5 a link at 0.8 shares no band with a chance of 1.4 in a million.
    """
    return near_dup.deduplicated(docs, percent=80, bands=34, rows=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks, with ``copy`` from 0."""
    return mixing.emitted(mixing.mixed(docs))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: SQL can express neither the language models nor the search for benchmark items with edits.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs
