"""Driver contract: entry runs; every oracle has a query; every query builds a plan."""

import __spark_entry__ as E
from conftest import SF

from weftview.plans import registry


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 50
    assert df.columns == ["page_id", "url", "title", "main_tag", "main_pos", "main_len"]


def test_every_oracle_has_a_query_and_plans(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    qs = registry.queries()
    for name, fn in qs.items():
        assert fn(spark, SF).schema is not None, name


def test_empty_and_null_pages_keep_their_rows(spark):
    import tempfile

    d = tempfile.mkdtemp(prefix="weftview-pages-")
    rows = [(1, "https://a.org/x", "<html><head><title>A</title></head><body><p>text</p></body></html>"),
            (2, "https://a.org/empty", ""), (3, "https://a.org/null", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    q = E.queries()
    main = {r.page_id: r for r in q["main_content"](spark, d).collect()}
    assert set(main) == {1, 2, 3}
    assert main[1].title == "A" and main[2].title == "No Title" and main[3].url == "https://a.org/null"
    raw = {r.page_id: r.markdown for r in q["raw_markdown"](spark, d).collect()}
    assert raw[2] == "# No Title\n\n**URL:** `https://a.org/empty`\n\n---\n\n"
    text = {r.page_id: r.text for r in q["plain_text"](spark, d).collect()}
    assert text == {1: "A\ntext", 2: "", 3: ""}
    assert q["page_rejects"](spark, d).count() == 2
    outs = sorted((r.page_id, r.view_id, r.status) for r in q["view_outputs"](spark, d).collect())
    assert outs == [(1, "raw", "loaded"), (1, "terminal", "unavailable"),
                    (2, "raw", "loaded"), (3, "raw", "loaded")]
