"""Registered queries for markdown views and text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggs import ordered_join
from ..functions.sqltext import lit
from ..functions.text import escape_markup, escape_markup_sql, truncate, truncate_sql
from ..operators import markdown as M
from ..operators.content import page_title_agg
from ..sources.responses import load_pages
from ..sources.tables import table
from . import sql_structure as S
from .structure import ORACLE as STRUCTURE_ORACLE
from .structure import stored_responses, structure


def rendered(spark: SparkSession, d: str, view: str, max_chars=None) -> DataFrame:
    """Per page: ``page_id, url, title, md, loaded`` for the ``raw`` or ``clean`` view.

    ``loaded``: the page had HTML (it produced at least one token).

    The markdown body is normalised; the raw view also gets D3/D4, the clean
    view D3 and D5 (``max_chars``).  Headers are added by the callers.
    """
    raw = view == "raw"
    st = structure(spark, d, with_url=True)
    st = M.render_context(st, None if raw else "keep")
    st = st.withColumn("frag", M.fragment(images=raw, raw=raw))
    md_agg = ordered_join("frag", ["pos"], "", None if raw else "keep")
    g = st.groupBy("page_id").agg(F.max("url").alias("url"), page_title_agg(whole_page=raw).alias("title"),
                                  md_agg.alias("md"),
                                  F.max("pos").isNotNull().alias("loaded"))
    md = M.normalize_md(F.coalesce(F.col("md"), F.lit("")))
    md = M.unwrap_link_targets(md)
    md = M.strip_link_target_spaces(md) if raw else truncate(md, max_chars)
    g = g.withColumn("md", md)
    return g.select("page_id", "url", F.coalesce("title", F.lit("No Title")).alias("title"),
                    F.coalesce("md", F.lit("\n")).alias("md"), "loaded")


def raw_markdown(spark, d):
    r = rendered(spark, d, "raw")
    return r.select("page_id", "url",
                    F.concat(M.raw_header(F.col("title"), F.col("url")), F.col("md")).alias("markdown"))


def clean_text(spark, d, max_chars=None):
    r = rendered(spark, d, "clean", max_chars)
    return r.select("page_id", "url",
                    F.concat(M.clean_header(F.col("title"), F.col("url")), F.col("md")).alias("text"))


def raw_header(spark, d):
    r = rendered(spark, d, "raw")
    return r.select("page_id", M.raw_header(F.col("title"), F.col("url")).alias("header"))


def clean_header(spark, d):
    r = rendered(spark, d, "clean")
    return r.select("page_id", M.clean_header(F.col("title"), F.col("url")).alias("header"))


# Model links written by one shared expression, so D3/D4 run on real text.
def _doc_markdown(spark, d) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", F.concat(
        F.col("text"), F.lit(" [source](< "), F.coalesce("source", F.lit("")),
        F.lit(" /doc/ "), F.col("doc_id").cast("string"), F.lit(" >)")).alias("md"))


def _doc_markdown_sql() -> str:
    return ("(SELECT doc_id, text || ' [source](< ' || coalesce(source, '') || ' /doc/ ' "
            "|| doc_id::VARCHAR || ' >)' AS md FROM documents)")


def link_unwrap(spark, d):
    m = _doc_markdown(spark, d)
    return m.select("doc_id", M.unwrap_link_targets(F.col("md")).alias("md"))


def link_space_fix(spark, d):
    m = _doc_markdown(spark, d)
    return m.select("doc_id", M.strip_link_target_spaces(M.unwrap_link_targets(F.col("md"))).alias("md"))


TRUNCATE_LIMITS = (100, 1000, 0, -1)


def truncate_text(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    x = docs.select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in TRUNCATE_LIMITS]))
                    .alias("max_chars"))
    out = truncate(F.col("text"), F.col("max_chars"))
    return x.select("doc_id", F.col("max_chars").cast("long").alias("max_chars"), out.alias("text"),
                    F.length(out).cast("long").alias("n_chars"))


def escape_markup_q(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", escape_markup(F.col("text")).alias("escaped"))


ERROR_PAGE = "## ❌ Error parsing HTML\n\n```\n{}\n```"


def page_errors(spark, d):
    """A page that cannot be converted becomes an error page, not a failure."""
    failed = load_pages(stored_responses(spark, d)).where(F.col("html").isNull())
    return failed.select("page_id", "url", F.format_string(ERROR_PAGE.replace("{}", "%s"), F.col("reason")).alias("markdown"))


QUERIES = {
    "raw_markdown": raw_markdown,
    "clean_text": clean_text,
    "raw_header": raw_header,
    "clean_header": clean_header,
    "link_unwrap": link_unwrap,
    "link_space_fix": link_space_fix,
    "truncate_text": truncate_text,
    "escape_markup": escape_markup_q,
    "page_errors": page_errors,
}


# --- oracle -------------------------------------------------------------------

def render_ctes(view: str, max_chars: int | None = None) -> str:
    """CTEs ending in ``rendered_<view>(page_id, url, title, md)``."""
    raw = view == "raw"
    mask = "true" if raw else "keep"
    md = M.normalize_md_sql("coalesce(md, '')")
    md = M.unwrap_link_targets_sql(md)
    limit = "NULL::BIGINT" if max_chars is None else str(int(max_chars))
    md = M.strip_link_target_spaces_sql(md) if raw else truncate_sql(md, limit)
    filt = "" if raw else " FILTER (WHERE keep)"
    return S.structure_ctes() + f""",
{M.context_sql("structure", "rc6", mask)},
rc7 AS (SELECT *, {M.fragment_sql(images=raw, raw=raw)} AS frag FROM rc6),
rg AS (SELECT page_id, {S.title_agg_sql(whole_page=raw)} AS title,
  string_agg(frag, '' ORDER BY pos){filt} AS md FROM rc7 GROUP BY page_id),
rendered_{view} AS (SELECT page_id, url, coalesce(title, 'No Title') AS title,
  coalesce({md}, chr(10)) AS md FROM pages LEFT JOIN rg USING (page_id))"""


def _raw(select: str) -> str:
    return f"WITH {render_ctes('raw')}\nSELECT {select} FROM rendered_raw"


def _clean(select: str) -> str:
    return f"WITH {render_ctes('clean')}\nSELECT {select} FROM rendered_clean"


_LIMITS_SQL = ", ".join(str(n) for n in TRUNCATE_LIMITS)

ORACLE = {
    "raw_markdown": _raw(f"page_id, url, {M.raw_header_sql('title', 'url')} || md AS markdown"),
    "clean_text": _clean(f"page_id, url, {M.clean_header_sql('title', 'url')} || md AS text"),
    "raw_header": _raw(f"page_id, {M.raw_header_sql('title', 'url')} AS header"),
    "clean_header": _clean(f"page_id, {M.clean_header_sql('title', 'url')} AS header"),
    "link_unwrap": f"SELECT doc_id, {M.unwrap_link_targets_sql('md')} AS md FROM {_doc_markdown_sql()}",
    "link_space_fix": f"SELECT doc_id, {M.strip_link_target_spaces_sql(M.unwrap_link_targets_sql('md'))} "
                      f"AS md FROM {_doc_markdown_sql()}",
    "truncate_text": f"SELECT doc_id, max_chars::BIGINT AS max_chars, "
                     f"{truncate_sql('text', 'max_chars')} AS text, "
                     f"length({truncate_sql('text', 'max_chars')})::BIGINT AS n_chars "
                     f"FROM documents, (SELECT unnest([{_LIMITS_SQL}]) AS max_chars)",
    "escape_markup": f"SELECT doc_id, {escape_markup_sql('text')} AS escaped FROM documents",
    "page_errors": f"SELECT page_id, url, replace({lit(ERROR_PAGE)}, '{{}}', reason) AS markdown FROM ({STRUCTURE_ORACLE['page_rejects']})",
}
