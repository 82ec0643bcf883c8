"""Registered queries over page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CONTENT_SELECTORS, MAIN_NOISE_SELECTORS, PAGE_NOISE_SELECTORS
from ..functions.aggs import ordered_join
from ..functions.sqltext import lit
from ..functions.text import trim_ws, trim_ws_sql
from ..operators.content import page_structure, page_title_agg, selector_predicate
from ..operators.tokens import attr_name, attr_pair_value, elements, tokenize, with_selector_attrs
from ..operators.tables import CELL_MIN, LINK_MIN, ROW_MIN, ROW_SEP, table_rows
from ..sources.responses import load_pages
from ..sources.tables import pages, table
from . import sql_structure as S


def structure(spark: SparkSession, d: str, with_url: bool = False) -> DataFrame:
    """Page structure over the token relation; ``with_url`` for per-page outputs."""
    cols = ("page_id", "url", "html") if with_url else ("page_id", "html")
    return page_structure(tokenize(pages(spark, d, *cols), with_url=with_url))


# --- A1 / A3: loaded and failed pages --------------------------------------

def page_scan(spark, d):
    p = pages(spark, d, "page_id", "url", "html")
    return (p.where(F.col("html").isNotNull() & (F.col("html") != ""))
            .select("page_id", "url", F.length("html").cast("long").alias("n_chars")))


# --- A1-A3: responses as a crawler stores them -----------------------------------

# --- fixed values: what a page's response is like, by page_id ----------------------
DECLARED_CHARSETS = (None, "utf-8", "ISO-8859-1", "ascii", "windows-1252")
STORED_AS = ("UTF-8", "UTF-8", "ISO-8859-1", "UTF-8", "ISO-8859-1")
NO_BODY, EMPTY, NOT_FOUND = 3, 5, 7  # of page_id modulo FAILS
FAILS = 10


def stored_responses(spark, d) -> DataFrame:
    """Each page as a stored response: a body in some charset (declared, not declared or declared
    as servers do by default; every `e` accented, so that bytes matter), some of them failed."""
    p = pages(spark, d, "page_id", "url", "html")
    k = F.pmod(F.col("page_id"), F.lit(len(DECLARED_CHARSETS)))
    fail = F.pmod(F.col("page_id"), F.lit(FAILS))
    cs = F.element_at(F.array(*[F.lit(c).cast("string") for c in DECLARED_CHARSETS]), (k + 1).cast("int"))
    html = F.translate("html", "e", "é")
    latin = k.isin(*[i for i, c in enumerate(STORED_AS) if c != "UTF-8"])
    body = F.when(fail == EMPTY, F.lit(b"")).when(fail != NO_BODY, F.when(latin, F.encode(html, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8")))
    return p.select("page_id", "url", F.when(fail == NOT_FOUND, 404).otherwise(200).alias("status"), cs.alias("charset"), body.alias("body"))


def page_rejects(spark, d):
    """A3: responses that gave no page, with the reason and the message shown."""
    return load_pages(stored_responses(spark, d)).where(~F.col("ok")).select("page_id", "url", "reason", "message")


def charset_decode(spark, d):
    """A1, A2: the pages of the responses that loaded, decoded."""
    return load_pages(stored_responses(spark, d)).select("page_id", "url", "charset", "ok", "html")


# --- C1-C5 --------------------------------------------------------------------

def html_tokens(spark, d):
    t = tokenize(pages(spark, d, "page_id", "html"))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "kind", "tag",
                    F.col("sign").cast("long").alias("sign"),
                    F.length("tok").cast("long").alias("tok_len"),
                    F.col("tlen").alias("text_len"))


def html_attrs(spark, d):
    t = tokenize(pages(spark, d, "page_id", "html")).where(F.col("kind") == "start")
    a = t.select("page_id", "pos", F.posexplode("attrs").alias("attr_pos", "a"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"),
                    F.col("attr_pos").cast("long").alias("attr_pos"),
                    attr_name(F.col("a")).alias("name"), attr_pair_value(F.col("a")).alias("value"))


def html_elements(spark, d):
    e = elements(tokenize(pages(spark, d, "page_id", "html")))
    return (e.where((F.col("sign") == 1) | F.col("kind").isin("start", "raw"))
            .select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    F.col("level").cast("long").alias("level"),
                    F.col("close_pos").cast("long").alias("close_pos")))


def element_text_len(spark, d):
    e = elements(tokenize(pages(spark, d, "page_id", "html")))
    return (e.where(F.col("elem_len").isNotNull())
            .select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    F.col("elem_len").cast("long").alias("text_len")))


_SETS = (("content", CONTENT_SELECTORS), ("main_noise", MAIN_NOISE_SELECTORS),
         ("page_noise", PAGE_NOISE_SELECTORS))


def selector_hits(spark, d):
    t = with_selector_attrs(tokenize(pages(spark, d, "page_id", "html")))
    t = t.where(F.col("kind").isin("start", "raw"))
    hits = F.array(*[
        F.when(selector_predicate(sel), F.struct(F.lit(name).alias("sel_set"),
                                                 F.lit(i).cast("long").alias("sel_rank"),
                                                 F.lit(sel).alias("selector")))
        for name, sels in _SETS for i, sel in enumerate(sels, 1)])
    x = t.select("page_id", "pos", "tag", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", "h.sel_set",
                    "h.sel_rank", "h.selector")


# --- C6-C10 -------------------------------------------------------------------

def _per_page(spark, d, *aggs) -> DataFrame:
    """One row per page (empty pages included), ``url`` carried through the shuffle."""
    st = structure(spark, d, with_url=True)
    return st.groupBy("page_id").agg(F.max("url").alias("url"), *aggs)


def page_title(spark, d):
    r = _per_page(spark, d, page_title_agg().alias("title"))
    return r.select("page_id", "url", F.coalesce("title", F.lit("No Title")).alias("title"))


def main_content(spark, d):
    r = _per_page(spark, d, page_title_agg().alias("title"),
                  F.max("main_tag").alias("main_tag"),
                  F.max("main_pos").cast("long").alias("main_pos"),
                  F.max("main_len").cast("long").alias("main_len"))
    return r.select("page_id", "url", F.coalesce("title", F.lit("No Title")).alias("title"),
                    "main_tag", "main_pos", "main_len")


def clean_blocks(spark, d):
    st = structure(spark, d).where("keep")
    return st.select("page_id", F.col("pos").cast("long").alias("pos"), "kind", "tag",
                     F.when(F.col("main_pos").isNotNull(), "main").otherwise("page").alias("branch"))


def plain_text(spark, d):
    st = structure(spark, d, with_url=True).withColumn("line", trim_ws(F.col("text")))
    g = st.groupBy("page_id").agg(
        F.max("url").alias("url"),
        ordered_join("line", ["pos"], "\n", F.col("keep") & (F.col("tlen") > 0)).alias("text"))
    return g.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))


# --- C11: table rows over pages built from orders and customers ---------------

def table_pages(spark, d) -> DataFrame:
    """One HTML table page per order (same ``concat`` as the oracle's)."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit("<html><body><table><tr><th>Order</th><th>Customer</th><th>Status</th>"
              "<th>Priority</th><th>More</th></tr><tr><td><a href=\"/orders/"), key,
        F.lit("\">Order "), key, F.lit("</a></td><td>"), F.col("c_name"),
        F.lit("<table><tr><td>"), F.col("c_mktsegment"), F.lit("</td></tr></table></td><td>"),
        F.col("o_orderstatus"), F.lit("</td><td>"), F.col("o_orderpriority"),
        F.lit("</td><td><a href=\"#top\">top</a> <a href=\"\">view all</a></td></tr></table>"
              "</body></html>"))
    return j.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def table_rows_q(spark, d):
    return table_rows(table_pages(spark, d))


QUERIES = {
    "page_scan": page_scan,
    "page_rejects": page_rejects,
    "charset_decode": charset_decode,
    "html_tokens": html_tokens,
    "html_attrs": html_attrs,
    "html_elements": html_elements,
    "element_text_len": element_text_len,
    "selector_hits": selector_hits,
    "page_title": page_title,
    "main_content": main_content,
    "clean_blocks": clean_blocks,
    "plain_text": plain_text,
    "table_rows": table_rows_q,
}


# --- oracle -------------------------------------------------------------------

def _sel_hits_sql() -> str:
    arms = []
    for name, sels in _SETS:
        for i, sel in enumerate(sels, 1):
            arms.append(f"SELECT page_id, pos::BIGINT AS pos, tag, {lit(name)} AS sel_set, "
                        f"{i}::BIGINT AS sel_rank, {lit(sel)} AS selector FROM sa "
                        f"WHERE kind IN ('start', 'raw') AND {S.selector_sql(sel)}")
    sel_attrs = ",\n  ".join(f"{S.attr_value_sql('attrs', n)} AS {c}"
                             for n, c in S._ATTR_COL.items())
    return (f"WITH {S.tokens_ctes()},\nsa AS (SELECT *, {sel_attrs} FROM tokens)\n"
            + "\nUNION ALL\n".join(arms))


def _per_page_sql(cols: str) -> str:
    return (f"WITH {S.structure_ctes()},\n"
            f"g AS (SELECT page_id, {S.title_agg_sql()} AS title, max(main_tag) AS main_tag, "
            f"max(main_pos)::BIGINT AS main_pos, max(main_len)::BIGINT AS main_len "
            f"FROM structure GROUP BY page_id)\n"
            f"SELECT {cols} FROM pages p LEFT JOIN g USING (page_id)")


ORACLE = {
    "page_scan": "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages "
                 "WHERE html IS NOT NULL AND html <> ''",
    "html_tokens": f"WITH {S.tokens_ctes()}\nSELECT page_id, pos::BIGINT AS pos, kind, tag, "
                   f"sign::BIGINT AS sign, length(tok)::BIGINT AS tok_len, "
                   f"tlen::BIGINT AS text_len FROM tokens",
    "html_attrs": f"WITH {S.tokens_ctes()},\n"
                  f"a AS (SELECT page_id, pos, unnest(range(len(attrs))) AS attr_pos, "
                  f"unnest(attrs) AS a FROM tokens WHERE kind = 'start')\n"
                  f"SELECT page_id, pos::BIGINT AS pos, attr_pos::BIGINT AS attr_pos, "
                  f"{S.attr_name_sql('a')} AS name, {S.attr_pair_value_sql('a')} AS value FROM a",
    "html_elements": f"WITH {S.tokens_ctes()},{S.elements_ctes()}\n"
                     f"SELECT page_id, pos::BIGINT AS pos, tag, level::BIGINT AS level, "
                     f"close_pos::BIGINT AS close_pos FROM elements "
                     f"WHERE sign = 1 OR kind IN ('start', 'raw')",
    "element_text_len": f"WITH {S.tokens_ctes()},{S.elements_ctes()}\n"
                        f"SELECT page_id, pos::BIGINT AS pos, tag, elem_len::BIGINT AS text_len "
                        f"FROM elements WHERE elem_len IS NOT NULL",
    "selector_hits": _sel_hits_sql(),
    "page_title": _per_page_sql(f"page_id, url, coalesce(title, 'No Title') AS title"),
    "main_content": _per_page_sql("page_id, url, coalesce(title, 'No Title') AS title, "
                                  "main_tag, main_pos, main_len"),
    "clean_blocks": f"WITH {S.structure_ctes()}\nSELECT page_id, pos::BIGINT AS pos, kind, tag, "
                    f"CASE WHEN main_pos IS NOT NULL THEN 'main' ELSE 'page' END AS branch "
                    f"FROM structure WHERE keep",
    "plain_text": f"WITH {S.structure_ctes()},\n"
                  f"g AS (SELECT page_id, string_agg({trim_ws_sql('text')}, chr(10) ORDER BY pos) "
                  f"AS text FROM structure WHERE keep AND tlen > 0 GROUP BY page_id)\n"
                  f"SELECT page_id, url, coalesce(text, '') AS text FROM pages LEFT JOIN g USING (page_id)",
}


_TABLE_PAGES = (
    "(SELECT o_orderkey AS page_id, '<html><body><table><tr><th>Order</th><th>Customer</th>"
    "<th>Status</th><th>Priority</th><th>More</th></tr><tr><td><a href=\"/orders/' || o_orderkey::VARCHAR || "
    "'\">Order ' || o_orderkey::VARCHAR || '</a></td><td>' || c_name || '<table><tr><td>' || c_mktsegment || "
    "'</td></tr></table></td><td>' || o_orderstatus || '</td><td>' || o_orderpriority || "
    "'</td><td><a href=\"#top\">top</a> <a href=\"\">view all</a></td></tr></table></body></html>' AS html "
    "FROM orders JOIN customer ON o_custkey = c_custkey)")


def _table_rows_sql() -> str:
    groups = {"table": ("table",), "row": ("tr",), "cell": ("td", "th"), "link": ("a",)}
    run = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def tags(n):
        return ", ".join(lit(x) for x in n)

    sums = ",\n  ".join(f"sum(CASE WHEN tag IN ({tags(n)}) THEN sign ELSE 0 END) OVER {run} AS s_{g}"
                         for g, n in groups.items())
    depths = ",\n  ".join(f"s_{g} - least(0, min(s_{g}) OVER {run}) AS d_{g}" for g in groups)
    spans = " UNION ALL ".join(
        f"SELECT o.page_id, {lit(g)} AS g, o.pos, o.href, o.d_table, coalesce(min(c.pos), 1e9) AS stop FROM ti o LEFT JOIN ti c "
        f"ON c.page_id = o.page_id AND c.pos > o.pos AND c.d_{g} < o.d_{g} WHERE o.tag IN ({tags(n)}) AND o.sign = 1 GROUP BY ALL"
        for g, n in groups.items() if g != "table")
    text = trim_ws_sql("coalesce(txt, '')")
    href = "coalesce(href, '')"
    return f"""WITH {S.tokens_ctes(_TABLE_PAGES)},
tt AS (SELECT *, CASE WHEN tag = 'a' THEN {S.attr_value_sql('attrs', 'href')} END AS href FROM tokens),
ti1 AS (SELECT *, {sums} FROM tt),
ti AS MATERIALIZED (SELECT *, {depths} FROM ti1),
el AS MATERIALIZED ({spans}),
tx AS (SELECT e.page_id, e.g, e.pos, any_value(e.href) AS href, string_agg(t.text, '' ORDER BY t.pos) AS txt
  FROM el e LEFT JOIN ti t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.stop AND t.kind = 'text' GROUP BY e.page_id, e.g, e.pos),
ce AS (SELECT c.page_id, c.pos AS cell, c.stop, bool_or(l.pos IS NOT NULL) AS has_link FROM el c LEFT JOIN el l
  ON l.page_id = c.page_id AND l.g = 'link' AND l.pos > c.pos AND l.pos < c.stop WHERE c.g = 'cell' GROUP BY ALL),
items AS (
  SELECT ce.page_id, cell, x.pos AS item_pos, CASE WHEN length({text}) > {LINK_MIN} THEN (CASE WHEN {href} <> '' AND NOT starts_with({href}, '#')
    THEN '[' || {text} || '](' || {href} || ')' ELSE {text} END) END AS item
  FROM ce JOIN tx x ON x.page_id = ce.page_id AND x.g = 'link' AND x.pos > cell AND x.pos < stop
  UNION ALL
  SELECT ce.page_id, cell, cell, CASE WHEN length({text}) > {CELL_MIN} THEN {text} END
  FROM ce JOIN tx x ON x.page_id = ce.page_id AND x.g = 'cell' AND x.pos = cell WHERE NOT has_link),
rw AS (SELECT r.page_id, r.pos AS row_pos, string_agg(item, {lit(ROW_SEP)} ORDER BY cell, item_pos) AS text
  FROM el r JOIN items i ON i.page_id = r.page_id AND i.cell > r.pos AND i.cell < r.stop
  WHERE r.g = 'row' AND r.d_table > 0 AND item IS NOT NULL GROUP BY r.page_id, r.pos)
SELECT page_id, row_pos::BIGINT AS row_pos, text FROM rw WHERE length(text) > {ROW_MIN}"""


ORACLE["table_rows"] = _table_rows_sql()

_CS_LIST = "[" + ", ".join("NULL" if c is None else lit(c) for c in DECLARED_CHARSETS) + "]::VARCHAR[]"
REASON_SQL = (f"CASE WHEN page_id % {FAILS} = {NOT_FOUND} THEN 'HTTP 404' WHEN page_id % {FAILS} = {NO_BODY} OR html IS NULL THEN 'no response' "
           f"WHEN page_id % {FAILS} = {EMPTY} OR html = '' THEN 'empty page' END")
ORACLE["page_rejects"] = (f"SELECT page_id, url, {REASON_SQL} AS reason, 'Failed to load ' || coalesce(url, '') AS message "
                          f"FROM pages WHERE {REASON_SQL} IS NOT NULL")
LATIN_SQL = ", ".join(str(i) for i, c in enumerate(STORED_AS) if c != "UTF-8")
STORED_HTML_SQL = (f"CASE WHEN page_id % {len(STORED_AS)} IN ({LATIN_SQL}) THEN regexp_replace(replace(html, 'e', 'é'), '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') "
                "ELSE replace(html, 'e', 'é') END")
ORACLE["charset_decode"] = (
    f"SELECT page_id, url, ({_CS_LIST})[(page_id % {len(DECLARED_CHARSETS)}) + 1] AS charset, "
    f"{REASON_SQL} IS NULL AS ok, CASE WHEN {REASON_SQL} IS NULL THEN {STORED_HTML_SQL} END AS html FROM pages")
