"""Registered queries for links and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LINK_RE
from ..functions.sqltext import lit
from ..functions.text import trim_ws_sql
from ..functions.urls import (
    default_scheme,
    default_scheme_sql,
    link_class,
    link_class_sql,
    resolve_url,
    resolve_url_sql,
)
from ..operators import links as L
from ..operators.markdown import clean_header_sql, raw_header, raw_header_sql
from ..sources.tables import pages
from .batch import page_views
from .render import render_ctes, rendered
from .structure import EMPTY, FAILS, LATIN_SQL, NO_BODY, REASON_SQL, STORED_AS, STORED_HTML_SQL, stored_responses


def raw_docs(spark, d) -> DataFrame:
    """The raw view per page as the reference stores it: header + markdown."""
    r = rendered(spark, d, "raw")
    return r.select("page_id", "url",
                    F.concat(raw_header(F.col("title"), F.col("url")), F.col("md")).alias("markdown"))


def raw_links(spark, d) -> DataFrame:
    return L.extract_links(raw_docs(spark, d), ["page_id", "url"], "markdown")


def links(spark, d):
    return raw_links(spark, d).drop("url")


def resolved_links(spark, d) -> DataFrame:
    return raw_links(spark, d).withColumn("resolved", resolve_url(F.col("target"), F.col("url")))


def resolve_url_q(spark, d):
    return resolved_links(spark, d).select("page_id", "link_idx", "target", "resolved")


def link_class_q(spark, d):
    r = resolved_links(spark, d)
    return r.select("page_id", "link_idx", "resolved", link_class(F.col("resolved")).alias("link_class"))


FOUND_MSG = "links on this page: {}"
NONE_MSG = "this page has no links to follow"


def link_counts(spark, d):
    """Links per page of the raw view, zero included (counted in-row, no join)."""
    p = raw_docs(spark, d).select("page_id", L.link_count(F.col("markdown")).alias("n_links"))
    cnt = F.col("n_links")
    msg = F.when(cnt > 0, F.format_string(FOUND_MSG.replace("{}", "%d"), cnt)).otherwise(NONE_MSG)
    return p.select("page_id", F.lit("raw").alias("view_id"), cnt.alias("n_links"), msg.alias("message"))


def link_ring_q(spark, d):
    return L.link_ring(links(spark, d), "page_id")


def view_link_counts(spark, d):
    """E6 for every view that is rendered: both come from one pass over the pages."""
    v = page_views(pages(spark, d, "page_id", "url", "html"))
    return v.select("page_id", "view_id", L.link_count(F.col("content")).alias("n_links"))


# --- fixed values: which link is selected, page_id modulo this (some pages have fewer links) ---
SELECTED_OF = 9


def link_highlight(spark, d):
    k = F.pmod(F.col("page_id"), F.lit(SELECTED_OF)).cast("int")
    return raw_docs(spark, d).select("page_id", L.highlight_nth(F.col("markdown"), k).alias("markdown"))


def page_manifest(spark, d):
    """Which stored pages there are and which of them loaded, without their HTML."""
    body = F.col("body")
    ok = (F.col("status") < 400) & body.isNotNull() & (F.octet_length(body) > 0)
    return stored_responses(spark, d).select("page_id", "url", F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(ok, F.lit(False)).alias("ok"))


def pages_by_url(spark, d) -> DataFrame:
    """One target page per URL (lowest id) among pages that loaded; partial aggregation absorbs hot URLs."""
    return page_manifest(spark, d).where("ok").groupBy("url").agg(F.min("page_id").alias("target_page_id"))


def _followable(spark, d) -> DataFrame:
    """Links of the raw view plus each page's canonical link to itself
    (``[title](url)``), both documents made from one rendered row."""
    r = rendered(spark, d, "raw")
    docs = r.select("page_id", "url", F.explode(F.array(
        F.struct(F.lit("raw").alias("link_set"),
                 F.concat(raw_header(F.col("title"), F.col("url")), F.col("md")).alias("markdown")),
        F.struct(F.lit("self").alias("link_set"),
                 F.concat(F.lit("["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
                 .alias("markdown")))).alias("doc"))
    docs = docs.select("page_id", "url", "doc.link_set", "doc.markdown")
    lk = L.extract_links(docs, ["page_id", "url", "link_set"], "markdown")
    lk = lk.withColumn("resolved", resolve_url(F.col("target"), F.col("url")))
    return lk.where(link_class(F.col("resolved")) == "navigate")


def follow_links(spark, d):
    lk = _followable(spark, d)
    tgt = pages_by_url(spark, d).withColumnRenamed("url", "resolved")
    j = lk.join(tgt, "resolved", "inner")
    return j.select("page_id", "link_set", "link_idx", "resolved", "target_page_id")


def unresolved_links(spark, d):
    lk = _followable(spark, d)
    tgt = pages_by_url(spark, d).withColumnRenamed("url", "resolved")
    j = lk.join(tgt, "resolved", "left_anti")
    return j.select("page_id", "link_set", "link_idx", "resolved")


def url_scheme(spark, d):
    p = pages(spark, d, "page_id", "url")
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)
    sub = p.select("page_id", F.posexplode(F.array(
        F.col("url"), host, F.concat(F.lit("  "), host, F.lit("\t")), F.lit(" "))).alias("k", "submitted"))
    out = sub.select("page_id", F.col("k").cast("long").alias("k"), "submitted",
                     default_scheme(F.col("submitted")).alias("url"))
    return out.where(F.col("url").isNotNull())


QUERIES = {
    "links": links,
    "resolve_url": resolve_url_q,
    "link_class": link_class_q,
    "link_counts": link_counts,
    "view_link_counts": view_link_counts,
    "page_manifest": page_manifest,
    "link_ring": link_ring_q,
    "link_highlight": link_highlight,
    "follow_links": follow_links,
    "unresolved_links": unresolved_links,
    "url_scheme": url_scheme,
}


# --- oracle -------------------------------------------------------------------

def links_ctes(src: str, keys: str = "page_id, url", md: str = "markdown", out: str = "links") -> str:
    """CTEs ending in ``<out>(<keys>, link_idx, text, target, start_pos, end_pos)``."""
    t = trim_ws_sql("target")
    unwrapped = (f"(CASE WHEN starts_with({t}, '<') AND ends_with({t}, '>') THEN "
                 f"(CASE WHEN length({t}) >= 2 THEN substr({t}, 2, length({t}) - 2) ELSE '' END) "
                 f"ELSE {t} END)")
    return f"""
{out}_m0 AS (SELECT {keys}, regexp_extract_all({md}, {lit(LINK_RE)}, 0) AS wh,
  regexp_extract_all({md}, {lit(LINK_RE)}, 1) AS tx, regexp_extract_all({md}, {lit(LINK_RE)}, 2) AS tg,
  regexp_split_to_array({md}, {lit(LINK_RE)}) AS gp FROM {src}),
{out}_m1 AS (SELECT {keys}, unnest(range(len(wh))) AS i, unnest(wh) AS whole, unnest(tx) AS text,
  unnest(tg) AS target, unnest(gp[1:len(wh)]) AS gap FROM {out}_m0),
{out}_m2 AS (SELECT {keys}, i, {trim_ws_sql('text')} AS text, {unwrapped} AS target,
  sum(length(gap) + length(whole)) OVER (PARTITION BY {keys} ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(whole) AS start_pos,
  length(whole) AS wlen FROM {out}_m1),
{out}_m3 AS (SELECT * FROM {out}_m2 WHERE NOT (target = '' OR starts_with(target, '#')
  OR contains(target, 'vote?') OR starts_with(target, 'from?site='))),
{out} AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1)::BIGINT AS link_idx,
  text, target, start_pos::BIGINT AS start_pos, (start_pos + wlen)::BIGINT AS end_pos FROM {out}_m3)"""


def _raw_docs_ctes() -> str:
    return render_ctes("raw") + (f",\nraw_docs AS (SELECT page_id, url, "
                                 f"{raw_header_sql('title', 'url')} || md AS markdown FROM rendered_raw)")


def _links_sql(select: str, extra: str = "") -> str:
    return f"WITH {_raw_docs_ctes()},{links_ctes('raw_docs')}{extra}\n{select}"


def _view_counts_sql(view: str) -> str:
    header = (raw_header_sql if view == "raw" else clean_header_sql)("title", "url")
    docs = render_ctes(view) + f",\nvd AS (SELECT page_id, url, {header} || md AS markdown FROM rendered_{view})"
    return (f"WITH {docs},{links_ctes('vd')} SELECT vd.page_id, {lit(view)} AS view_id, count(l.page_id)::BIGINT AS n_links "
            f"FROM vd LEFT JOIN links l ON l.page_id = vd.page_id GROUP BY vd.page_id")


_RING = """,
r0 AS (SELECT page_id, link_idx, target,
  count(*) OVER (PARTITION BY page_id) AS n,
  coalesce(lead(target) OVER (PARTITION BY page_id ORDER BY link_idx),
           first_value(target) OVER (PARTITION BY page_id ORDER BY link_idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_url,
  coalesce(lag(target) OVER (PARTITION BY page_id ORDER BY link_idx),
           last_value(target) OVER (PARTITION BY page_id ORDER BY link_idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_url,
  first_value(target) OVER (PARTITION BY page_id ORDER BY link_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_url
  FROM links)"""

_FOLLOW = f""",
self_docs AS (SELECT page_id, url, '[' || title || '](' || url || ')' AS markdown FROM rendered_raw),
{links_ctes('self_docs', out='self_links').lstrip()},
lk AS (SELECT *, 'raw' AS link_set FROM links UNION ALL SELECT *, 'self' AS link_set FROM self_links),
lkr AS (SELECT * FROM (SELECT *, {resolve_url_sql('target', 'url')} AS resolved FROM lk) WHERE {link_class_sql('resolved')} = 'navigate'),
tgt AS (SELECT url AS resolved, min(page_id) AS target_page_id FROM pages WHERE {REASON_SQL} IS NULL GROUP BY url)"""

_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"

ORACLE = {
    "links": _links_sql("SELECT page_id, link_idx, text, target, start_pos, end_pos FROM links"),
    "resolve_url": _links_sql(f"SELECT page_id, link_idx, target, {resolve_url_sql('target', 'url')} "
                              f"AS resolved FROM links"),
    "link_class": _links_sql(f"SELECT page_id, link_idx, {resolve_url_sql('target', 'url')} AS resolved, "
                             f"{link_class_sql(resolve_url_sql('target', 'url'))} AS link_class FROM links"),
    "link_counts": _links_sql(
        "SELECT p.page_id, 'raw' AS view_id, coalesce(n, 0)::BIGINT AS n_links, "
        f"CASE WHEN coalesce(n, 0) > 0 THEN {lit(FOUND_MSG.split('{}')[0])} || n::VARCHAR || "
        f"{lit(FOUND_MSG.split('{}')[1])} ELSE {lit(NONE_MSG)} END AS message "
        "FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY page_id) c "
        "USING (page_id)"),
    "link_ring": _links_sql(
        "SELECT page_id, link_idx AS cur_idx, ((link_idx + 1) % n + n) % n AS next_idx, "
        "((link_idx - 1) % n + n) % n AS prev_idx, next_url, prev_url FROM r0 "
        "UNION ALL SELECT page_id, -1::BIGINT, 0::BIGINT, ((-2 % n) + n) % n, first_url, "
        "CASE WHEN n = 1 THEN target ELSE prev_url END FROM r0 WHERE link_idx = n - 1", _RING),
    "link_highlight": _links_sql(
        "SELECT d.page_id, CASE WHEN l.start_pos IS NULL THEN d.markdown ELSE "
        "substr(d.markdown, 1, l.start_pos) || '**→ [' || l.text || '](' || l.target || ') ←**' || "
        "substr(d.markdown, l.end_pos + 1) END AS markdown "
        f"FROM raw_docs d LEFT JOIN (SELECT * FROM links WHERE link_idx = page_id % {SELECTED_OF}) l USING (page_id)"),
    "page_manifest": f"SELECT page_id, url, CASE WHEN page_id % {FAILS} = {EMPTY} THEN 0 WHEN page_id % {FAILS} <> {NO_BODY} THEN strlen({STORED_HTML_SQL}) - "
                     f"CASE WHEN page_id % {len(STORED_AS)} IN ({LATIN_SQL}) THEN strlen({STORED_HTML_SQL}) - length({STORED_HTML_SQL}) ELSE 0 END ELSE 0 END AS n_bytes, "
                     f"{REASON_SQL} IS NULL AS ok FROM pages",
    "view_link_counts": "SELECT * FROM (" + _view_counts_sql("raw") + ") UNION ALL SELECT * FROM (" + _view_counts_sql("clean") + ")",
    "follow_links": _links_sql("SELECT page_id, link_set, link_idx, resolved, target_page_id "
                               "FROM lkr JOIN tgt USING (resolved)", _FOLLOW),
    "unresolved_links": _links_sql("SELECT page_id, link_set, link_idx, resolved FROM lkr "
                                   "WHERE resolved NOT IN (SELECT resolved FROM tgt WHERE resolved IS NOT NULL) "
                                   "AND resolved IS NOT NULL", _FOLLOW),
    "url_scheme": f"SELECT * FROM (SELECT page_id, k::BIGINT AS k, submitted, "
                  f"{default_scheme_sql('submitted')} AS url FROM (SELECT page_id, "
                  f"unnest(range(4)) AS k, unnest([url, {_HOST}, '  ' || {_HOST} || chr(9), ' ']) "
                  f"AS submitted FROM pages)) WHERE url IS NOT NULL",
}
