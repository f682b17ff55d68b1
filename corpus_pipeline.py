"""The training-corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept, and all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm.bpe import bpe_encoding
from wayloom.llm.decontamination import drop_contaminated
from wayloom.llm.exact_dedup import drop_exact_copies
from wayloom.llm.language_id import drop_unknown
from wayloom.llm.near_dedup import drop_near_copies
from wayloom.llm.queries import tokenizer_path
from wayloom.llm.shared import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: without a letter they go."""
    return drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded text."""
    return bpe_encoding(docs, tokenizer_path()).drop("decoded")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("bpe", tokens)]

#: Word shingles, SVMs and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
