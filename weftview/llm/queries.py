"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import conversation_repair, decontam, embed_neardup, langid, licenses, merkle, oracles, packing, quality, secrets, suffix_dedup, token_counts, toxicity
from .common import fold, saved, table, vocabulary
from .ngram_join import jaccard_components


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "label")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.scored(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    model = quality.learn(docs, labels.where(fold("doc_id", 3) != 1))
    return quality.scored(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = langid.learn(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"), PATTERN)


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(fold("doc_id", 3) == 0, F.lit(False))
    return merkle.verified(docs, F.when(tampered, lowered).otherwise(F.col("text")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hurt = conversation_repair.damaged(given)
    found = saved(conversation_repair.audits(hurt))
    ends = conversation_repair.repaired(hurt, found).where("sha256 is not null").select("conv_id", F.col("sha256").alias("repaired_sha256"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # a conversation is in each part once; sums and maxima skip the parts it is not in
    every = given.select("conv_id").distinct().unionByName(found, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents", "doc_id", "text"))


_ALL = [op1_embedding_near_duplicates, op2_cost_balanced_packing, op3_noisy_channel_toxicity,
        op4_suffix_dedup, op5_byte_cnn_quality, op6_ppm_language_id, op7_template_decontamination,
        op8_ngram_jaccard_join, op9_token_counts, op10_linked_secrets, op11_merkle_manifest,
        op12_conversation_repair, op13_license_scan]


def queries() -> dict:
    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return dict(oracles.SQL)
