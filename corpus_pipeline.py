"""The corpus pipeline: five operators in a row, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adtflow.llm import bpe, classifier, decontamination, jaccard, pii
from adtflow.llm.queries import QUALITY_THRESHOLD, tokenizer_path
from adtflow.llm.shared import ship_package, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: those whose score reaches the threshold, with all columns.

    Null and empty texts have the score of a text without features; equal texts stay or go together; without labels of both classes
    the score is the labels' mean, or 0.5 for none. An empty table stays so.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return classifier.keep_scored(docs, model, QUALITY_THRESHOLD)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Null texts, empty ones and those without words are near duplicates of nothing and stay. Rows repeated under one id and text stay
    or go together; rows without an id go if a near duplicate has one. An empty table stays so.
    """
    ship_package(spark)
    return jaccard.keep_one(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item, with all columns.

    Null and empty texts overlap with nothing and stay, as do all documents where the benchmark is empty; equal texts stay or go
    together. An empty table stays so.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kinds and n_chars brought up to date; no row goes.

    Null texts stay null and empty ones empty; repeated rows are handled alike; other columns stay. An empty table stays so.
    """
    ship_package(spark)
    return pii.redacted(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, counted and digested, and its text decoded from them, digested.

    Null and empty texts have no tokens; null ids stay null; repeated rows each have a row. An empty table gives no rows.
    """
    ship_package(spark)
    return bpe.bpe_round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_private_data),
    ("BPE encoding and decoding", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what each stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs


#: A classifier and a tagger can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
