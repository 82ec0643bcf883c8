"""Batch jobs: pages -> view content + links (A4, A6, D1, D2, E1-E3); prompts -> answers (A5).

Both views come from one tokenisation: the raw and clean render contexts are
computed one after the other in the same ``(page_id, pos)`` order, and a single
``groupBy(page_id)`` produces both documents.  The result is written to
``<out>/view_content`` partitioned by ``view_id`` (readers of one view prune the
other), then read back to extract links into ``<out>/links``: the second stage
starts from the written table, so a lost executor recomputes from there, not
from the HTML.  Writes are whole-directory overwrites, so a re-run is safe.

Usage: ``python -m weftview.plans.batch PAGES_PARQUET OUT_DIR [MAX_CHARS]``
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggs import ordered_join
from ..functions.patterns import DEFAULT_MODEL
from ..functions.text import truncate
from ..operators import markdown as M
from ..operators.completion import complete_requests
from ..operators.content import page_structure, page_title_agg
from ..operators.links import extract_links
from ..operators.tokens import tokenize


def page_views(pages: DataFrame, max_chars: int | None = None, placed: bool = False) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, view_id, content)`` for raw and clean.

    ``placed``: the pages are a table of ``sources.crawl``, and the plan has no exchange."""
    st = page_structure(tokenize(pages.select("page_id", "url", "html"), with_url=True, placed=placed))
    st = M.render_context(st).withColumn("frag_raw", M.fragment(images=True, raw=True))
    st = st.drop(*M.CONTEXT_COLUMNS)
    st = M.render_context(st, "keep").withColumn("frag_clean", M.fragment(images=False, raw=False))
    j = st.groupBy("page_id").agg(
        F.max("url").alias("url"),
        page_title_agg().alias("title"),
        page_title_agg(whole_page=True).alias("raw_title"),
        ordered_join("frag_raw", ["pos"]).alias("raw_md"),
        ordered_join("frag_clean", ["pos"], "", "keep").alias("clean_md"))
    raw = M.strip_link_target_spaces(M.unwrap_link_targets(
        M.normalize_md(F.coalesce("raw_md", F.lit("")))))
    clean = truncate(M.unwrap_link_targets(M.normalize_md(F.coalesce("clean_md", F.lit("")))), max_chars)
    title, raw_title = F.coalesce("title", F.lit("No Title")), F.coalesce("raw_title", F.lit("No Title"))
    both = F.array(
        F.struct(F.lit("raw").alias("view_id"),
                 F.concat(M.raw_header(raw_title, F.col("url")), F.coalesce(raw, F.lit("\n")))
                 .alias("content")),
        F.struct(F.lit("clean").alias("view_id"),
                 F.concat(M.clean_header(title, F.col("url")), F.coalesce(clean, F.lit("\n")))
                 .alias("content")))
    return (j.select("page_id", "url", F.explode(both).alias("v"))
            .select("page_id", "url", "v.view_id", "v.content"))


def write_page_views(spark: SparkSession, pages: DataFrame, out_dir: str,
                     max_chars: int | None = None, placed: bool = False) -> dict[str, str]:
    """Write ``view_content`` (partitioned by ``view_id``) and ``links``; return their paths."""
    out = out_dir.rstrip("/")
    views_path, links_path = f"{out}/view_content", f"{out}/links"
    page_views(pages, max_chars, placed).write.mode("overwrite").partitionBy("view_id").parquet(views_path)
    raw = spark.read.parquet(views_path).where(F.col("view_id") == "raw")
    links = extract_links(raw.select("page_id", "url", "content"), ["page_id", "url"], "content")
    links.write.mode("overwrite").parquet(links_path)
    return {"view_content": views_path, "links": links_path}

def answer_prompts(prompts: DataFrame, make_client, model: str | None = None,
                   default_model: str | None = None) -> DataFrame:
    """A5: ``prompts(prompt_id, prompt)`` -> ``(prompt_id, model, answer, error_kind)``.

    Each prompt becomes one request (``model`` overrides the default), the
    completion stage streams chunks, and the answer is their ordered join (G2);
    a failed request keeps the chunks it produced plus its error text.
    """
    chosen = model or default_model or DEFAULT_MODEL
    reqs = prompts.select(F.col("prompt_id").alias("page_id"), F.lit("prompt").alias("view_id"),
                          F.lit(chosen).alias("model"), "prompt")
    chunks = complete_requests(reqs, make_client, default_model or DEFAULT_MODEL)
    return chunks.groupBy(F.col("page_id").alias("prompt_id")).agg(
        F.max("model").alias("model"),
        ordered_join("chunk", ["seq"]).alias("answer"),
        F.max("error_kind").alias("error_kind"))


def main(argv: list[str]) -> None:
    if len(argv) < 2:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("weftview-batch").getOrCreate()  # master as submitted
    pages = spark.read.parquet(argv[0]).select("page_id", "url", "html")
    max_chars = int(argv[2]) if len(argv) > 2 else None
    print(write_page_views(spark, pages, argv[1], max_chars))


if __name__ == "__main__":
    main(sys.argv[1:])

