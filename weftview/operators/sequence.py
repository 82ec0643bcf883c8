"""Ordered per-key operators that stay parallel when one key is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; if
one session holds a third of all rows, that task does a third of the work.
These helpers window within ``(key, bucket)`` instead, where ``bucket`` is a
contiguous range of the order, and stitch the buckets together through a
per-bucket aggregate that is tiny next to the rows: one row per (key, bucket).
Results are exact.

``range_buckets`` takes the buckets from Spark's range partitioning of
``(key, order)``: its bounds come from a sample of the data, so a key holding a
third of all rows is cut into about a third of the buckets, however its rows
are spread in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def default_buckets(df: DataFrame) -> int:
    """``max(2 x defaultParallelism, spark.sql.shuffle.partitions)``."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_buckets(df: DataFrame, keys: list[str], order: list[str], n: int | None = None,
                  out: str = "_b") -> DataFrame:
    """Add ``out``: the range partition of the row in ``(keys, order)`` order.

    Partition ids are monotone in that order, so each (key, bucket) is a
    contiguous run of the key's rows.  The count is fixed (a repartition by
    number is not coalesced by AQE): ``max(2 x defaultParallelism,
    spark.sql.shuffle.partitions)`` unless given.

    Spark samples the bounds anew for each exchange, so the rows are written
    with their bucket once: whatever reads them (rows and per-bucket carries)
    sees the same buckets, and the rows are range-partitioned once.
    """
    n = n or default_buckets(df)
    cols = [F.col(c) for c in [*keys, *order]]
    return written(df.repartitionByRange(n, *cols).withColumn(out, F.spark_partition_id().cast("long")))


def _ordkey(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _stitched(df: DataFrame, carry: DataFrame, keys: list[str], bucket: str, order: list[str],
              fn, out: str, inclusive: bool) -> DataFrame:
    """Apply the running window ``fn`` within (key, bucket), seeded by ``carry``.

    Each bucket's carry (the result of all earlier buckets) enters as a
    sentinel row ordered before the bucket's rows, so the window picks it up
    itself: no join of the carry back to the rows.  The window's own shuffle on
    (key, bucket) moves the sentinels with the rows; they are dropped after.
    """
    end = Window.currentRow if inclusive else -1
    rows = df.withColumn("_sentinel", F.lit(False))
    seeds = carry.withColumn("_sentinel", F.lit(True))
    u = rows.unionByName(seeds, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, bucket).orderBy(F.col("_sentinel").desc(), *order)
         .rowsBetween(Window.unboundedPreceding, end))
    return u.withColumn(out, fn(w)).where(~F.col("_sentinel")).drop("_sentinel")


def last_value_before(df: DataFrame, keys: list[str], bucket: str, order: list[str],
                      value: str, out: str, inclusive: bool) -> DataFrame:
    """``out`` = last non-NULL ``value`` at (inclusive) or before this row in key order.

    Within a bucket a window finds it; the last value of the nearest earlier
    bucket that has one is seeded into the bucket as a sentinel row.
    """
    # Every bucket gets a row (a bucket without values still needs the carry);
    # max_by skips rows whose ordering is NULL.
    per_bucket = (df.groupBy(*keys, bucket)
                  .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), _ordkey(order)))
                       .alias("_bucket_last")))
    wb = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, bucket, F.last("_bucket_last", ignorenulls=True).over(wb)
                              .alias(value))
    return _stitched(df, carry, keys, bucket, order,
                     lambda w: F.last(F.col(value), ignorenulls=True).over(w), out, inclusive)


def top_k_last(df: DataFrame, keys: list[str], bucket: str, order: list[str], k: int,
               rank_col: str = "from_end") -> DataFrame:
    """The last ``k`` rows per key in ``order``, with 1-based ``rank_col`` from the end.

    Two stages: the last ``k`` per (key, bucket), then the last ``k`` of those
    per key, which is at most ``k`` rows per bucket.
    """
    desc = [F.col(c).desc() for c in order]
    w1 = Window.partitionBy(*keys, bucket).orderBy(*desc)
    stage1 = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(*keys).orderBy(*desc)
    return (stage1.withColumn(rank_col, F.row_number().over(w2).cast("long"))
            .where(F.col(rank_col) <= k))


def prefix_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str],
               value: str, out: str, inclusive: bool) -> DataFrame:
    """``out`` = sum of ``value`` over rows at (inclusive) or before this one in key order.

    A running sum within the bucket, seeded with the totals of all earlier
    buckets as a sentinel row.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_bucket_sum"))
    wb = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, bucket, F.coalesce(F.sum("_bucket_sum").over(wb), F.lit(0))
                          .cast(df.schema[value].dataType).alias(value))
    return _stitched(df, carry, keys, bucket, order,
                     lambda w: F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"), out, inclusive)
