"""From raw documents to packed sequences: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weaksift.llm.common import read_table, stage
from weaksift.llm.exact import exact_stage
from weaksift.llm.language import language_stage
from weaksift.llm.mixing import mixing_stage
from weaksift.llm.near import near_stage
from weaksift.llm.packing import packing_query


LANGUAGES: tuple[str, ...] | None = None  # that stay; None: all that can be learned from the labelled documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of ``LANGUAGES`` by their text, which becomes their lang; the others, and those without a
    letter, go."""
    return language_stage(docs, languages=LANGUAGES)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles the one with the smallest id."""
    return near_stage(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, repeated, or one per source cut short."""
    return mixing_stage(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing_query(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # learned profiles, sampling keys and packing are not for SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
