"""Reading the input tables.

Only the named columns are selected, so the parquet scan's ReadSchema carries
just what the plan needs (``html`` is the wide column; it is read only by the
tokeniser).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "pages", *(columns or ("page_id", "url", "html")))
