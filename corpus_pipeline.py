"""Corpus preparation: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm.common import stage_table
from umbra.llm.contamination import drop_contaminated
from umbra.llm.langid import keep_known_languages
from umbra.llm.packing import pack_documents
from umbra.llm.queries import CAPACITY, tokenizer_path
from umbra.llm.similar import keep_one_of_similar
from umbra.llm.substrings import remove_substrings


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose language the network can't tell go; where lang is null it becomes the prediction."""
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on shingles of five words: the first document of each group stays.

    Groups are linked by pairs whose sets of shingles are checked to have a Jaccard similarity of 0.8 or more, all of them.
    """
    return keep_one_of_similar(docs, width=5)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: strings of 200 bytes that stand anywhere else too are taken out of the texts."""
    return remove_substrings(docs, length=200)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: what is left, in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), CAPACITY, 1)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Four of the stages aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
