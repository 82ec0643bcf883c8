"""Stored views that are replaced as pages are read again, with their links.

A store is a folder of Parquet tables, written by epochs.  ``upsert`` writes one epoch's
views, one for each ``(url, view_id)``, and the links of those views beside them; an epoch that is
written again replaces itself, so a batch may be run as often as it fails.  Of a key the
newest epoch holds, whatever order epochs arrive in.  ``compact`` merges what is
there into one base and drops the epochs in it; rows keep their epoch, so an epoch that arrives
late, or again, still loses to newer rows and wins over older ones.  Between the base's
commit and the drop rows stand twice; of equal epochs the base's count.

    <root>/views/epoch=<n>       url, view_id, content
    <root>/links/epoch=<n>       url, view_id, link_idx, text, target, start_pos, end_pos
    <root>/base/<k>/{views,links}  the same with epoch; the highest k with both tables counts

Which rows hold is decided on ``(url, view_id, epoch)`` alone; contents and links follow by a semi
join.  A NULL url or view_id is not a key: such rows are left out.  Of a key that an epoch has
twice, the row of the highest ``order_by`` counts, then the greatest content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import extract_links

KEY = ["url", "view_id"]
VIEW_SCHEMA = "url string, view_id string, content string"
LINK_SCHEMA = "url string, view_id string, link_idx long, text string, target string, start_pos long, end_pos long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def _committed(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def upsert(root: str, views: DataFrame, epoch: int, order_by: str | None = None) -> None:
    """Write an epoch: ``views`` (url, view_id, content) and their links."""
    spark = views.sparkSession
    best = F.max(F.struct(*([order_by] if order_by else []), "content")).alias("best")
    one = views.where("url is not null and view_id is not null").groupBy(*KEY).agg(best).select(*KEY, "best.content")
    one.write.mode("overwrite").parquet(f"{root}/views/epoch={epoch}")
    stored = spark.read.schema(VIEW_SCHEMA).parquet(f"{root}/views/epoch={epoch}")
    extract_links(stored, KEY, "content").write.mode("overwrite").parquet(f"{root}/links/epoch={epoch}")


def _base(spark: SparkSession, root: str) -> int:
    done = [int(k) for k in _folders(spark, f"{root}/base") if all(_committed(spark, f"{root}/base/{k}/{t}") for t in ("views", "links"))]
    return max(done, default=-1)


def _epochs(spark: SparkSession, root: str) -> list[int]:
    """Epochs whose links are written too: the views of an epoch count from then on."""
    return sorted(n for n in (int(e.split("=")[1]) for e in _folders(spark, f"{root}/links") if e.startswith("epoch="))
                  if _committed(spark, f"{root}/links/epoch={n}"))


def _rows(spark: SparkSession, root: str, table: str, base: int, epochs: list[int]) -> DataFrame:
    """All rows of a table with ``epoch`` and whether they are the base's."""
    schema = VIEW_SCHEMA if table == "views" else LINK_SCHEMA
    parts = [f"{root}/{table}/epoch={n}" for n in epochs]
    new = (spark.read.schema(f"{schema}, epoch long").option("basePath", f"{root}/{table}").parquet(*parts) if parts
           else spark.createDataFrame([], f"{schema}, epoch long"))
    new = new.withColumn("in_base", F.lit(False))
    if base < 0:
        return new
    old = spark.read.schema(f"{schema}, epoch long").parquet(f"{root}/base/{base}/{table}").withColumn("in_base", F.lit(True))
    return old.unionByName(new)


def _holding(rows: DataFrame) -> DataFrame:
    """The (url, view_id, epoch, in_base) that hold; only these narrow columns are read and shuffled."""
    return rows.groupBy(*KEY).agg(F.max(F.struct("epoch", "in_base")).alias("top")).select(*KEY, "top.epoch", "top.in_base")


def current(spark: SparkSession, root: str, table: str = "views") -> DataFrame:
    """The rows of ``views`` or ``links`` that hold, with their epoch."""
    return _current(spark, root, table, _base(spark, root), _epochs(spark, root))


def _current(spark: SparkSession, root: str, table: str, base: int, epochs: list[int]) -> DataFrame:
    holds = _holding(_rows(spark, root, "views", base, epochs))
    return _rows(spark, root, table, base, epochs).join(holds, [*KEY, "epoch", "in_base"], "left_semi").drop("in_base")


def link_counts(spark: SparkSession, root: str) -> DataFrame:
    """E6 for every stored view: ``url, view_id, epoch, n_links``, views without a link included."""
    per = current(spark, root, "links").groupBy(*KEY).agg(F.count("*").alias("n"))
    views = current(spark, root).select(*KEY, "epoch")
    return views.join(per, KEY, "left").select(*KEY, "epoch", F.coalesce("n", F.lit(0)).alias("n_links"))


def compact(spark: SparkSession, root: str) -> None:
    """Merge the base and all epochs into a new base, then drop what is in it."""
    base, epochs = _base(spark, root), _epochs(spark, root)
    for table in ("links", "views"):
        _current(spark, root, table, base, epochs).write.mode("overwrite").parquet(f"{root}/base/{base + 1}/{table}")
    gone = [f"{root}/base/{base}"] * (base >= 0) + [f"{root}/{t}/epoch={n}" for n in epochs for t in ("views", "links")]
    for path in gone:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
