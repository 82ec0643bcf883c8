"""A crawl stored for page queries: pages bucketed by ``page_id``, and a narrow manifest (A1, A4).

Every page plan partitions its tokens by ``page_id``.  A crawl whose files already are so needs no
exchange for it: the plan reads a bucket as one task, and a lost executor reads its buckets again
instead of asking for shuffle files.  The HTML moves once, when the crawl is stored, and not in each
job over it.  Questions about which pages there are and which of them loaded read the manifest,
whose rows hold no HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BYTES = 64 << 20
PAGE_COLUMNS = ("page_id", "url", "html")


def manifest(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, n_chars, n_bytes, ok), one per page: a null or empty page did not load
    (ok false, both lengths 0).  Repeated ids keep a row each."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.length(html).cast("long").alias("n_chars"),
                        F.octet_length(html).cast("long").alias("n_bytes"), (html != "").alias("ok"))


def bucket_count(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the pages of a manifest: one per ``bucket_bytes`` of HTML, and no fewer than the
    cluster's cores, as the work follows the bytes."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))


def write_crawl(pages: DataFrame, name: str, location: str, buckets: int | None = None,
                bucket_bytes: int = BUCKET_BYTES) -> int:
    """Store ``pages(page_id, url, html)`` as table ``name``, bucketed by ``page_id``, under
    ``location``/pages and its manifest under ``location``/manifest; return the number of buckets.

    Columns other than these three are not stored.  Pages with a null id share a bucket.  Both are
    overwritten whole, so that a rerun is safe.  ``location`` must not hold the pages read.
    """
    spark, root = pages.sparkSession, location.rstrip("/")
    pages = pages.select(*PAGE_COLUMNS)
    manifest(pages).write.mode("overwrite").parquet(f"{root}/manifest")
    n = buckets or bucket_count(read_manifest(spark, location), bucket_bytes)
    # the same hash places rows in partitions and in buckets: one file a bucket
    (pages.repartition(n, "page_id").write.mode("overwrite").format("parquet").bucketBy(n, "page_id").sortBy("page_id")
     .option("path", f"{root}/pages").saveAsTable(name))
    return n


def register_crawl(spark: SparkSession, name: str, location: str, buckets: int) -> DataFrame:
    """The stored pages as table ``name`` of a session whose catalogue does not know them."""
    path = location.rstrip("/").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (page_id BIGINT, url STRING, html STRING) USING parquet "
              f"CLUSTERED BY (page_id) SORTED BY (page_id) INTO {buckets} BUCKETS LOCATION '{path}/pages'")
    return spark.table(name)


def read_manifest(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(f"{location.rstrip('/')}/manifest")
