"""Stored crawls: page plans over them have no exchange, the manifest answers without the HTML."""

import os
import sys
import tempfile

from conftest import SF
from weftview.operators.content import page_structure
from weftview.operators.tokens import tokenize
from weftview.plans.batch import page_views, write_page_views
from weftview.sources.crawl import bucket_count, manifest, read_manifest, register_crawl, write_crawl

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_shapes import shape  # noqa: E402


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_page_plans_over_a_stored_crawl_have_no_exchange(spark):
    out = tempfile.mkdtemp(prefix="weftview-crawl-")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    n = write_crawl(pages, "crawl_a", out, buckets=6)
    stored = spark.table("crawl_a")
    assert n == 6 and _same(stored, pages)
    views = page_views(stored, placed=True)
    plan = _plan(views)
    s = shape(plan)
    assert s["shuffles"] == s["joins"] == s["broadcasts"] == s["python"] == 0
    assert "Bucketed: true" in plan
    assert _same(views, page_views(pages))
    # a plan that shuffles shows that the rest of the tests would see an exchange
    assert shape(_plan(page_views(stored)))["shuffles"] == 1
    # the same files in a session whose catalogue does not know them
    again = register_crawl(spark, "crawl_b", out, 6)
    assert shape(_plan(page_structure(tokenize(again, with_url=True, placed=True))))["shuffles"] == 0
    assert _same(again, pages)
    # files and the job over them: one file a bucket, the same tables as from loose pages
    files = {r[0] for r in again.selectExpr("input_file_name()").distinct().collect()}
    assert len(files) <= 6
    got = write_page_views(spark, again, f"{out}/placed", placed=True)
    want = write_page_views(spark, pages, f"{out}/loose")
    for table in got:
        assert _same(spark.read.parquet(got[table]), spark.read.parquet(want[table]))
    # a rerun overwrites
    write_crawl(pages, "crawl_a", out, buckets=6)
    assert spark.table("crawl_a").count() == pages.count()


def test_pages_not_placed_give_the_same_views(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").repartition(3)
    assert _same(page_views(pages, placed=True), page_views(pages))


def test_manifest_rows(spark):
    rows = [(1, "u", "héllo"), (2, "v", ""), (None, "w", None), (1, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = tempfile.mkdtemp(prefix="weftview-crawl-")
    write_crawl(pages.selectExpr("*", "'extra' AS ok"), "crawl_c", out, buckets=2)
    got = sorted(map(tuple, read_manifest(spark, out).collect()), key=repr)
    assert got == sorted([(1, "u", 5, 6, True), (2, "v", 0, 0, False), (None, "w", 0, 0, False), (1, None, 1, 1, True)], key=repr)
    assert spark.table("crawl_c").columns == ["page_id", "url", "html"] and spark.table("crawl_c").count() == 4
    assert "html" not in read_manifest(spark, out).columns


def test_buckets_follow_the_bytes(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = manifest(spark.range(cores * 3).selectExpr("id AS page_id", "'u' AS url", "repeat('a', 1000) AS html"))
    assert bucket_count(rows, 1000) == cores * 3
    assert bucket_count(rows, 1 << 20) == cores
    assert bucket_count(rows.limit(0)) == cores
