"""A corpus pipeline: from documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes the result of every stage to the shared
folder and goes on from there, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdrift.llm import decontaminate, jaccard, mixing, quality, token_files
from subdrift.llm.common import shared_folder, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays."""
    return jaccard.one_of_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the characters; rows may repeat now."""
    mixed = mixing.mix(docs, size=F.coalesce(F.length("text"), F.lit(0)).cast("double"))
    return mixed.drop(mixing.COPY, mixing.ORDER)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens"
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_test_items),
    ("mixing", mixed_sources),
    ("token files", token_table),
]

# Alignment and tokenizing are beyond SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
