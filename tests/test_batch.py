"""The batch job writes the same views and links as the registered queries."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from weftview.plans.batch import write_page_views


def test_batch_job_equals_queries(spark):
    out = tempfile.mkdtemp(prefix="weftview-batch-")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    paths = write_page_views(spark, pages, out)
    views = spark.read.parquet(paths["view_content"])
    q = E.queries()
    raw = q["raw_markdown"](spark, SF).select("page_id", F.col("markdown").alias("content"))
    clean = q["clean_text"](spark, SF).select("page_id", F.col("text").alias("content"))
    got_raw = views.where("view_id = 'raw'").select("page_id", "content")
    got_clean = views.where("view_id = 'clean'").select("page_id", "content")
    for got, want in ((got_raw, raw), (got_clean, clean)):
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    links = spark.read.parquet(paths["links"]).drop("url")
    want_links = q["links"](spark, SF)
    assert links.exceptAll(want_links).count() == 0 and want_links.exceptAll(links).count() == 0
    # a re-run overwrites rather than appends
    write_page_views(spark, pages, out)
    assert spark.read.parquet(paths["view_content"]).count() == 2 * pages.count()


def test_answer_prompts_with_fake_client(spark):
    import sys

    from pyspark import cloudpickle

    from weftview.plans.batch import answer_prompts

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    prompts = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    out = answer_prompts(prompts, _echo_client, model="echo/1")
    rows = {r.prompt_id: r for r in out.collect()}
    assert len(rows) == prompts.count()
    for r in prompts.collect():
        want = f"words: {len(r.prompt.split())}\n" + r.prompt.split()[0] if r.prompt.split() else "words: 0\n"
        assert rows[r.prompt_id].answer == want and rows[r.prompt_id].model == "echo/1"


def _echo_client(model):
    def complete(prompt):
        words = prompt.split()
        yield f"words: {len(words)}\n"
        if words:
            yield words[0]
    return complete
