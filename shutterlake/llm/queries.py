"""The queries of this subpackage; each applies its operator, with its usual parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmlcut, langid, linededup, media, mixing, ngram_join, quality, secretscan, sql, tokenfiles

TOKENIZER, VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op4_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(_table(spark, sf_dir, "documents"), public_path(VOCABULARY))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_tokens(tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), public_path(TOKENIZER)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_mincut, op2_language_id, op3_ngram_jaccard_join, op4_quality_weak_labels, op5_secret_scan, op6_source_mix, op7_token_files, op8_line_dedup, op9_decontamination, op10_media_columns)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Queries of this subpackage that SQL can express."""
    return {"op3_ngram_jaccard_join": sql.JACCARD_JOIN, "op9_decontamination": sql.DECONTAMINATION}
