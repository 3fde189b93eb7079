"""The queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, flac, lm, neardup, packing, secrets, spans, suffixes, toxicity
from .common import read_table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(read_table(spark, sf_dir, "documents"), content=True)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read_table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(read_table(spark, sf_dir, "documents"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.report(read_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentence_spans, op3_secrets, op4_packing, op5_bpe, op6_suffixes, op7_lm, op8_flac, op9_ann, op10_neardup)}
ORACLES: dict[str, str] = {}
