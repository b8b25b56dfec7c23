"""A training corpus from documents: quality, repeated lines, near-duplicates, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from susceptra.llm import linededup, mixing, pieces, quality, simhash
from susceptra.llm.text import table
from susceptra.storage import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return quality.keep_good(docs, sf_dir)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal and nearly equal lines the first stays."""
    return linededup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of near-duplicate documents the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents as often as the mix takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, n_tokens, and digests of the ids and of the text decoded from them; a row per row of docs."""
    return pieces.encoded_digests(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("mix", mixed_sources),
    ("tokens", tokens),
]

#: SQL cannot express the classifier, MinHash or SentencePiece; tests/llm checks the stages' operators by brute force and run()'s rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
