"""The corpus queries by name, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from glossator.llm import sql, vector_sql
from glossator.llm.common import documents
from glossator.llm.decontamination import contained_items
from glossator.llm.hard_negatives import hard_negative_report
from glossator.llm.language import language_report
from glossator.llm.line_dedup import line_report
from glossator.llm.media import media_report
from glossator.llm.mixing import mix_report
from glossator.llm.repeats import repeats_digest
from glossator.llm.secrets import secret_report
from glossator.llm.simhash import simhash_components
from glossator.llm.token_output import token_output
from glossator.llm.toxicity import toxicity_report
from glossator.llm.vector_codes import vector_code_report
from glossator.llm.warc import warc_report


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(documents(spark, sf_dir))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negative_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_repeats": op6_repeats,
    "op7_secrets": op7_secrets,
    "op8_media": op8_media,
    "op9_token_output": op9_token_output,
    "op10_simhash": op10_simhash,
    "op11_warc": op11_warc,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | vector_sql.oracle_sql()
