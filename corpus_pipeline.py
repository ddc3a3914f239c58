"""From raw documents to token ids, in five stages.

Each stage is written as Parquet and read again before the next one.  What a stage's operator kept
in the shared folder is deleted when the next stage of the same run starts, since by then its
result is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, common, decontamination, exact_dedup, language_id, ngram_join

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_leftover: list[str] = []


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function is not _language:
            common.delete(spark, _leftover)
        _leftover.clear()
        with common.recording(_leftover):
            return function(spark, docs, sf_dir)

    return run


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or like none of the languages, go."""
    return language_id.known_languages(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep(docs, shingle=5, num=80, den=100)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, and the text that they decode to."""
    found = byte_bpe.decode(byte_bpe.encode(docs))
    return found.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(_language)),
    ("exact_dedup", _stage(_exact)),
    ("near_duplicates", _stage(_near)),
    ("decontamination", _stage(_clean)),
    ("byte_bpe", _stage(_tokens)),
]

#: Language vectors and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
