"""The corpus pipeline: documents through five training-data operators, each stage written and read again.

Every stage but the last takes and returns the columns of documents, whatever others there are, and decides about rows,
not identifiers: a row with a null or repeated doc_id goes or stays by its text. Empty tables pass through as they are.
All stages run on the same executors, so each begins by giving back the memory that those before it have left there.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from textwarden.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, toxicity
from textwarden.llm.common import collect_executors, table, written


def from_little(stage):
    """A stage that begins on executors without the garbage of earlier ones."""

    @functools.wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_executors(spark)
        return stage(spark, docs, sf_dir)

    return wrapped


@from_little
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier calls toxic go.

    Null and empty texts are scored as such; without labels of both kinds nothing is called toxic unless all labels are.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@from_little
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts, one row stays, that of the smallest doc_id (null last; one of repeated rows).

    Null texts count as empty, so all empty documents are one text.
    """
    return exact_dedup.survivors(docs)


@from_little
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays (five words, similarity of 0.8 or more).

    That is the row of the smallest doc_id (null last); documents without words are in no group and stay.
    """
    return near_dedup.survivors(docs, percent=80)


@from_little
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go; null and empty texts hold none, null items are in none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@from_little
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token counts and digests of the ids and of the decoded bytes, a row per row; null texts are empty."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]
#: A trained network and a tokenizer have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
