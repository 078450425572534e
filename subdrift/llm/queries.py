"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdrift.llm import conversations, decontaminate, jaccard, lexical_search, licenses, line_templates, mixing, private_data, quality, quality_classifier, repeated_bytes, repeated_words, token_files
from subdrift.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.concat_ws(",", spans))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"))
    long_repeat = F.col("longest_repeat") >= quality.Limits().long_repeat
    return judged.withColumn("has_long_repeat", long_repeat).drop("longest_repeat", "n_maximal_repeats")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_templates(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the mix, measured in characters."""
    documents = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(documents, size=F.coalesce(F.length("text"), F.lit(0)).cast("double"))
    return mixed.select(
        "doc_id", "source", "copy", "shuffle_key", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in private_data.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op9_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_words.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by what the labels outside of the held-out fold teach."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = quality_classifier.fitted(documents, labels.where(quality_classifier.fold(F.col("doc_id")) != 0))
    return quality_classifier.scored(documents, machine).select(
        "doc_id", (quality_classifier.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; those whose rows are all gone have zeros."""
    given = _table(spark, sf_dir, "conversations")
    repaired = conversations.repair(conversations.damaged(given)).withColumnRenamed("conv_id", "_conv_id")
    joined = given.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return lexical_search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_license_scan": op2_license_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_line_templates": op5_line_templates,
        "op6_mixing": op6_mixing,
        "op7_repeated_bytes": op7_repeated_bytes,
        "op8_private_data": op8_private_data,
        "op9_repeated_words": op9_repeated_words,
        "op10_token_files": op10_token_files,
        "op11_quality_classifier": op11_quality_classifier,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }
