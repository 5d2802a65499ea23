"""A training-data pipeline over documents, in five stages that each read all their predecessor kept.

The forest of the quality rules and the rounding of the mix have no SQL form, so ORACLE_SQL is None; the operators of the
stages are tested against brute-force versions, the stages on the tables and on an empty one.

Null and empty texts have no words: the quality rules reject them. Repeated rows are near duplicates, of which one stays.
Very long texts go through whole. An empty table gives an empty result with the last stage's columns. Extra columns of
documents are kept until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phishscreen.llm import bpe, line_dedup, mixing, ngram_join, quality, queries

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_docs(docs, queries.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go from the texts, and documents of which nothing is left."""
    return line_dedup.dedup_docs(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.dedup_docs(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, go or are repeated, so that sources have their target shares."""
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens): the texts as token ids."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.codec()).drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mix_stage),
    ("byte-level BPE encoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
