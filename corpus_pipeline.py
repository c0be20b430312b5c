"""From raw documents to token files: the stages of a training corpus, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossator.llm.common import fresh_path
from glossator.llm.decontamination import decontaminate
from glossator.llm.mixing import mix
from glossator.llm.near_copies import drop_near_copies
from glossator.llm.token_output import token_output
from glossator.llm.toxicity import drop_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: 0.8 or more of their five-word shingles in common."""
    return drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean),
    ("near-duplicates", deduplicate),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: SQL can express neither the toxicity model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written to the shared folder and read back as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
