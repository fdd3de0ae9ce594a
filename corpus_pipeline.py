"""Corpus pipeline: quality rules, near duplicates, shared passages, mixing, encoding.

Each stage takes all documents its predecessor kept and returns the columns of
``documents``; the last returns the piece ids of every text in place of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moatlens.llm import mixing, ngram_join, pieces, substring_dedup
from moatlens.llm import quality_rules as qr
from moatlens.llm.common import read, written
from moatlens.llm.queries import vocabulary


#: Near duplicates: words of a shingle, least similarity in percent.
WORDS, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 1)."""
    return qr.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component of the n-gram Jaccard join (operator 5) on five words and 80 %."""
    return ngram_join.first_of_groups(docs, WORDS, SIMILAR)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of words that an earlier document holds (operator 10)."""
    return substring_dedup.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says (operator 9)."""
    return mixing.emit(mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with their original bytes, and the digest of what they decode to (operator 8)."""
    return pieces.tokenised(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", passages),
          ("mixing", mixed), ("sentencepiece", encoded)]
#: SQL can't express the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
