"""The corpus pipeline: five stages over documents, each working on what the one before it kept.

1. toxicity: rows that the classifier rejects go.
2. near_duplicates: one row of each class of near copies stays.
3. repeats: bytes of repeated windows are cut from texts; rows stay.
4. secrets: values of secrets are masked; rows stay.
5. packing: texts become token sequences, a row for each piece.

All but the last return the columns of documents.  Null texts stay null until
packing counts them as empty; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismframe.llm import neardup, packing, secrets, suffixes, toxicity
from prismframe.llm.common import checkpointed, read_table
from prismframe.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("secrets", mask_secrets), ("packing", pack)]
#: A learnt classifier, sampling, byte windows and a tokenizer: not for SQL. tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
