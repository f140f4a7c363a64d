"""From raw documents to token files: each stage works on all that the one before it kept.

Defined results of all stages: columns of the documents that are not named here stay as they are, whatever their names; rows may
repeat, and texts be of any length; an empty table goes through all stages and ends as an empty one. What a stage does with
nulls, ties and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm import decontam, langid, mixing, ngram_join, tokenfiles
from shutterlake.llm.queries import TOKENIZER, public_path
from shutterlake.llm.shared import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise.

    A null text, or one without letters, goes; a null language is not learned; equal cross-entropies go to the language that
    sorts first; repeated rows are all kept or all dropped.
    """
    return langid.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 connect: the one with the least doc_id.

    Of rows equal in doc_id and text one stays; rows with the same doc_id and other texts are judged on their own; a null doc_id
    is the last in order; texts without words, nulls too, all stay.
    """
    return ngram_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark windows: fewer than a twentieth of the words are in one.

    A null text has no words and stays; a null item has no windows; exactly a twentieth is contaminated; repeated rows are all
    kept or all dropped.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: each document as often as the mix takes it, shard by shard in shuffled order.

    A text of size 0, nulls too, is not in the mix; a null source is a source of its own, the last in order; rows equal in doc_id
    and text are taken alike.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens and ids_crc32 of each document.

    A null text has only the end id; a null doc_id sorts first; rows with equal doc_id stand in the order of their texts, each
    with its own start.
    """
    return tokenfiles.read_tokens(tokenfiles.write_tokens(docs, public_path(TOKENIZER)))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: SQL can express neither the language models nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scratch(spark)
    for name, stage in STAGES:
        own = Scratch(spark)
        docs = own.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.drop()
        before = own
    return docs
