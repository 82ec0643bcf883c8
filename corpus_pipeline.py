"""Training-data pipeline over `documents`: five stages, each by one operator of weftview.llm.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns what the next one
gets, written as Parquet and read again.  All but the last return the columns of documents.

* language_id: texts without a letter or a sure language go (prediction by partial matching, learned
  from the rows that have a language).
* ngram_join: of each group of near duplicates the document with the smallest id stays (word
  shingles of five, similarity 0.75).
* decontamination: documents that hold a benchmark item go.
* secret_scan: secrets and linked credential parts are replaced in the text; every document stays.
* packing: token sequences of 4096; rows are pieces.

Null and empty texts go in the first stage (they have no letter).  Rows without a doc_id match no
other row by id: they stay where a stage drops ids.  Rows that repeat an id and its text stay or go
together.  Extra columns stay up to the last stage.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftview.llm import decontam, langid, packing, secrets
from weftview.llm.common import saved, small, table, vocabulary
from weftview.llm.ngram_join import jaccard_components


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is none of ids (one column)."""
    gone = small(saved(ids.toDF("gone_id").distinct()))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = jaccard_components(docs.select("doc_id", "text"))
    return _without(docs, parts.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(docs, found.select("doc_id"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", pack)]

#: The tokenizer and the language model have no SQL: tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
