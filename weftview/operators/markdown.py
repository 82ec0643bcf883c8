"""Markdown rendering of the token relation.

Every token becomes a fragment through one rule table; a page's markdown is the
ordered concatenation of its fragments (``functions.aggs.ordered_join``),
grouped on the ``page_id`` partitioning the token relation already has.  The rule table is written once and turned into a Spark ``when`` chain
here and into a SQL ``CASE`` for the oracle, so both engines share one dialect.

Dialect: ``#`` headings; a blank line around block elements; ``**`` bold,
``_`` italic, backtick code; ``[text](href)`` links (``#`` targets render as
plain text); ``![alt](src)`` images in the raw view only; ``  * `` / ``  n. ``
list items, two more spaces for each list around; ``> `` before each line of a
block quote; two spaces and a newline for ``br``; ``[code]`` fences around
``pre`` (whose text stays as it is) in the raw view; `` | `` after table cells; ``* * *`` rules.  Text is entity-decoded and
whitespace-collapsed outside ``pre``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ANGLE_TARGET_RE, LINK_TARGET_RE, NO_TITLE, WS
from ..functions.sqltext import lit
from ..functions.text import collapse_ws, collapse_ws_sql, trim_ws, trim_ws_sql

# --- fixed values: the markdown dialect ---------------------------------------
BLOCK_TAGS = (
    "p", "div", "table", "article", "section", "main", "header", "footer", "nav",
    "aside", "form", "figure", "ul", "ol", "dl", "address", "fieldset", "details",
)
# tag -> (fragment on open, fragment on close)
FIXED_RULES = {
    **{t: ("\n\n", "\n\n") for t in BLOCK_TAGS},
    **{f"h{n}": ("\n\n" + "#" * n + " ", "\n\n") for n in range(1, 7)},
    "blockquote": ("\n\n", "\n\n"),
    "hr": ("\n\n* * *\n\n", ""),
    "tr": ("\n", "\n"), "td": ("", " | "), "th": ("", " | "),
    "dt": ("\n", ""), "dd": ("\n    ", ""),
}
EMPHASIS = {"b": "**", "strong": "**", "i": "_", "em": "_"}
LIST_TAGS = ("ul", "ol")
RAW_PRE = ("\n\n[code]\n", "\n[/code]\n\n")
CLEAN_PRE = ("\n\n", "\n\n")
# Stand-ins (noncharacters, so no text holds them) that live until the document is
# joined: a quote mark at a line's start, and white space that must stay as it is.
QUOTE, KEPT = "\uFDD0", {"\n": "\uFDD1", " ": "\uFDD2", "\t": "\uFDD3"}
BREAK = KEPT[" "] * 2 + "\n"


def _valid_href(h: Column) -> Column:
    return h.isNotNull() & (h != "") & ~h.startswith("#")


def render_context(t: DataFrame, mask: Column | str | None = None) -> DataFrame:
    """Add what fragments depend on besides the token itself.

    ``in_pre`` (inside a ``pre``), ``quote_d`` and ``list_d`` (open quotes and
    lists; a list item's own level), ``li_num`` (1-based number of an item whose
    list is an ``ol``; NULL = bullet), ``after_li`` (nothing but white space
    stands between a list item's start and the token).  Depths never fall below
    zero.  Expects the columns added by ``content.page_structure``.  Only tokens
    where ``mask`` (a boolean column, or its name) holds count: the clean view
    renders the kept ones.
    """
    stages = (_context_stages(mask) if mask is None or isinstance(mask, str)
              else _build_context_stages(mask))
    for stage in stages:
        t = t.withColumns(stage)
    return t.drop("_pre", "_quote", "_list", "_list_tag", "_n", "_n_at")


CONTEXT_COLUMNS = ("in_pre", "quote_d", "list_d", "li_num", "after_li")


@cache
def _context_stages(mask: str | None) -> list[dict[str, Column]]:
    return _build_context_stages(F.col(mask) if mask else None)


def _build_context_stages(mask: Column | None) -> list[dict[str, Column]]:
    mask = F.lit(True) if mask is None else mask
    sign, tag, kind = F.col("sign"), F.when(mask, F.col("tag")), F.col("kind")
    page = Window.partitionBy("page_id").orderBy("pos")
    w = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(*names):
        return F.sum(F.when(tag.isin(*names), sign).otherwise(0)).over(w)

    def clamped(c):
        return F.col(c) - F.least(F.lit(0), F.min(c).over(w))

    # A list item belongs to the last list opened at its level.
    level = Window.partitionBy("page_id", "list_d").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    opens_list = tag.isin(*LIST_TAGS) & (sign == 1)
    item = F.coalesce((tag == "li") & (sign == 1), F.lit(False))
    shown = mask & ~((kind == "text") & (F.col("tlen") == 0)) & ~kind.isin("comment", "decl")
    return [
        {"_pre": total("pre"), "_quote": total("blockquote"), "_list": total(*LIST_TAGS),
         "after_li": F.coalesce(F.last(F.when(shown, item), ignorenulls=True).over(
             page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))},
        {"in_pre": clamped("_pre") > 0, "quote_d": clamped("_quote"), "list_d": clamped("_list")},
        {"_list_tag": F.last(F.when(opens_list, F.col("tag")), ignorenulls=True).over(level),
         "_n": F.sum(item.cast("int")).over(level)},
        {"_n_at": F.last(F.when(opens_list, F.col("_n")), ignorenulls=True).over(level)},
        {"li_num": F.when(item & (F.col("_list_tag") == "ol"), F.col("_n") - F.col("_n_at"))},
    ]


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key]


@cache
def fragment(images: bool, raw: bool) -> Column:
    """Markdown fragment of one token (Spark form of ``fragment_sql``)."""
    kind, tag = F.col("kind"), F.col("tag")
    opening, closing = kind == "start", kind == "end"
    closed, opened = F.col("close_pos").isNotNull(), F.col("open_pos").isNotNull()
    pre = RAW_PRE if raw else CLEAN_PRE
    href, open_href = F.col("a_href"), F.col("open_a_href")
    held = F.translate("text", "".join(KEPT), "".join(KEPT.values()))
    f = F.when((kind == "text") | (kind == "raw") & (tag == "textarea"),
               F.when(F.col("in_pre"), held).otherwise(collapse_ws(F.col("text"))))
    f = f.when(opening & (tag == "a"), F.when(_valid_href(href) & closed, "[").otherwise(""))
    f = f.when(closing & (tag == "a"),
               F.when(_valid_href(open_href), F.concat(F.lit("]("), open_href, F.lit(")")))
               .otherwise(""))
    if images:
        src = F.col("a_src")
        f = f.when(opening & (tag == "img"),
                   F.when(src.isNotNull() & (src != ""),
                          F.concat(F.lit("!["), F.coalesce(F.col("a_alt"), F.lit("")),
                                   F.lit("]("), src, F.lit(")"))).otherwise(""))
    number = F.coalesce(F.concat(F.col("li_num").cast("string"), F.lit(". ")), F.lit("* "))
    f = f.when(opening & (tag == "li"), F.concat(
        F.lit("\n"), F.repeat(F.lit("  "), F.greatest(F.col("list_d"), F.lit(1)).cast("int")), number))
    # a list within a list starts and ends no block of its own
    f = f.when(opening & tag.isin(*LIST_TAGS) & (F.col("list_d") > 1), "")
    f = f.when(closing & tag.isin(*LIST_TAGS) & (F.col("list_d") > 0), "")
    f = f.when(opening & F.col("after_li") & tag.isin(*BLOCK_TAGS), "")
    f = f.when(opening & (tag == "pre"), pre[0]).when(closing & (tag == "pre") & opened, pre[1])
    f = f.when((tag == "code") & (opening | closing), F.when(F.col("in_pre"), "").otherwise("`"))
    f = f.when(tag.isin(*EMPHASIS) & (opening & closed | closing & opened), _lookup(EMPHASIS, tag))
    f = f.when(tag == "br", BREAK)
    f = f.when(opening, _lookup({t: o for t, (o, _) in FIXED_RULES.items()}, tag))
    f = f.when(closing, _lookup({t: c for t, (_, c) in FIXED_RULES.items()}, tag))
    f = F.coalesce(f, F.lit(""))
    mark = F.concat(F.lit("\n"), F.repeat(F.lit(QUOTE), F.col("quote_d").cast("int")))
    return F.when((F.col("quote_d") > 0) & (F.instr(f, "\n") > 0), F.replace(f, F.lit("\n"), mark)).otherwise(f)


def fragment_sql(images: bool, raw: bool) -> str:
    """The same fragment rule as SQL ``CASE`` text (oracle)."""
    pre = RAW_PRE if raw else CLEAN_PRE
    valid = "({h} IS NOT NULL AND {h} <> '' AND NOT starts_with({h}, '#'))"
    in_list = lambda tags: "tag IN (" + ", ".join(lit(t) for t in tags) + ")"
    held = f"translate(text, {lit(''.join(KEPT))}, {lit(''.join(KEPT.values()))})"
    arms = [
        f"WHEN kind = 'text' OR kind = 'raw' AND tag = 'textarea' "
        f"THEN (CASE WHEN in_pre THEN {held} ELSE {collapse_ws_sql('text')} END)",
        f"WHEN kind = 'start' AND tag = 'a' THEN (CASE WHEN {valid.format(h='a_href')} "
        f"AND close_pos IS NOT NULL THEN '[' ELSE '' END)",
        f"WHEN kind = 'end' AND tag = 'a' THEN (CASE WHEN {valid.format(h='open_a_href')} "
        f"THEN '](' || open_a_href || ')' ELSE '' END)",
    ]
    if images:
        arms.append("WHEN kind = 'start' AND tag = 'img' THEN (CASE WHEN a_src IS NOT NULL "
                    "AND a_src <> '' THEN '![' || coalesce(a_alt, '') || '](' || a_src || ')' "
                    "ELSE '' END)")
    arms += [
        "WHEN kind = 'start' AND tag = 'li' THEN chr(10) || repeat('  ', greatest(list_d, 1)::INT) "
        "|| coalesce(li_num::VARCHAR || '. ', '* ')",
        f"WHEN kind = 'start' AND {in_list(LIST_TAGS)} AND list_d > 1 THEN ''",
        f"WHEN kind = 'end' AND {in_list(LIST_TAGS)} AND list_d > 0 THEN ''",
        f"WHEN kind = 'start' AND after_li AND {in_list(BLOCK_TAGS)} THEN ''",
        f"WHEN kind = 'start' AND tag = 'pre' THEN {lit(pre[0])}",
        f"WHEN kind = 'end' AND tag = 'pre' AND open_pos IS NOT NULL THEN {lit(pre[1])}",
        "WHEN tag = 'code' AND kind IN ('start', 'end') THEN (CASE WHEN in_pre "
        "THEN '' ELSE '`' END)",
    ]
    for name, mark in EMPHASIS.items():
        arms.append(f"WHEN tag = {lit(name)} AND (kind = 'start' AND close_pos IS NOT NULL "
                    f"OR kind = 'end' AND open_pos IS NOT NULL) THEN {lit(mark)}")
    arms.append(f"WHEN tag = 'br' THEN {lit(BREAK)}")
    for name, (o, c) in FIXED_RULES.items():
        arms.append(f"WHEN kind = 'start' AND tag = {lit(name)} THEN {lit(o)}")
        arms.append(f"WHEN kind = 'end' AND tag = {lit(name)} THEN {lit(c)}")
    f = "(CASE " + " ".join(arms) + " ELSE '' END)"
    return f"replace({f}, chr(10), chr(10) || repeat({lit(QUOTE)}, quote_d::INT))"


def context_sql(src: str, out: str, mask: str) -> str:
    """CTEs ``rc1 ... out``: ``render_context`` of the relation ``src`` (oracle)."""
    w = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bef = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lvl = "(PARTITION BY page_id, list_d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    total = lambda cond: f"sum(CASE WHEN {cond} THEN sign ELSE 0 END) OVER {w}"
    clamp = lambda c: f"{c} - least(0, min({c}) OVER {w})"
    shown = f"{mask} AND NOT (kind = 'text' AND tlen = 0) AND kind NOT IN ('comment', 'decl')"
    return f"""rc1 AS (SELECT *, CASE WHEN {mask} THEN tag END AS mtag FROM {src}),
rc2 AS (SELECT *, coalesce(mtag = 'li' AND sign = 1, false) AS item,
  coalesce(mtag IN ('ul', 'ol') AND sign = 1, false) AS opens_list,
  {total("mtag = 'pre'")} AS pre_s, {total("mtag = 'blockquote'")} AS quote_s,
  {total("mtag IN ('ul', 'ol')")} AS list_s FROM rc1),
rc3 AS (SELECT *, coalesce(last_value(CASE WHEN {shown} THEN item END IGNORE NULLS) OVER {bef}, false) AS after_li,
  {clamp('pre_s')} > 0 AS in_pre, {clamp('quote_s')} AS quote_d, {clamp('list_s')} AS list_d FROM rc2),
rc4 AS (SELECT *, last_value(CASE WHEN opens_list THEN tag END IGNORE NULLS) OVER {lvl} AS list_tag,
  sum(item::INT) OVER {lvl} AS n_items FROM rc3),
rc5 AS (SELECT *, last_value(CASE WHEN opens_list THEN n_items END IGNORE NULLS) OVER {lvl} AS n_at FROM rc4),
{out} AS (SELECT *, CASE WHEN item AND list_tag = 'ol' THEN (n_items - n_at)::BIGINT END AS li_num FROM rc5)"""


_BLANK_LINES = rf"(?:\n{QUOTE}*){{2,}}(\n{QUOTE}*)"


# What normalize_md replaces: spaces before line ends, blank lines beyond the first,
# line ends before the first line (a quote mark stays) and behind the last.
_SPACES, _LEADING, _TRAILING = r"[ \t]+\n", rf"^[ \t]*(?:\n{QUOTE}*)*\n({QUOTE}*)", rf"[\n{QUOTE} \t]+$"


def normalize_md(md: Column) -> Column:
    """Drop spaces before line ends, squeeze blank lines, trim, end with a newline;
    then put quote marks and kept white space for their stand-ins."""
    md = F.regexp_replace(F.regexp_replace(md, _SPACES, "\n"), _BLANK_LINES, "\n$1")
    md = F.regexp_replace(F.regexp_replace(md, _LEADING, "$1"), _TRAILING, "")
    md = F.replace(F.concat(trim_ws(md), F.lit("\n")), F.lit(QUOTE), F.lit("> "))
    return F.translate(md, "".join(KEPT.values()), "".join(KEPT))


def normalize_md_sql(e: str) -> str:
    e = f"regexp_replace(regexp_replace({e}, {lit(_SPACES)}, chr(10), 'g'), {lit(_BLANK_LINES)}, chr(10) || '\\1', 'g')"
    e = f"regexp_replace(regexp_replace({e}, {lit(_LEADING)}, '\\1'), {lit(_TRAILING)}, '')"
    return (f"translate(replace({trim_ws_sql(e)} || chr(10), {lit(QUOTE)}, '> '), "
            f"{lit(''.join(KEPT.values()))}, {lit(''.join(KEPT))})")


def unwrap_link_targets(md: Column) -> Column:
    """D3: ``](<url>)`` -> ``](url)``."""
    return F.regexp_replace(md, ANGLE_TARGET_RE, "]($1)")


def unwrap_link_targets_sql(e: str) -> str:
    return f"regexp_replace({e}, {lit(ANGLE_TARGET_RE)}, '](\\1)', 'g')"


def strip_link_target_spaces(md: Column) -> Column:
    """Delete whitespace inside every ``](...)`` link target.

    Spark has no callback replace, so the text is split around the targets,
    the targets are cleaned, and both are zipped back together.
    """
    gaps = F.split(md, LINK_TARGET_RE, -1)
    targets = F.regexp_extract_all(md, F.lit(LINK_TARGET_RE), 1)
    # zip_with pads the shorter targets list with NULL; both arrays are computed
    # once per row (a lambda referring to an outer array would recompute it).
    pieces = F.zip_with(gaps, targets, lambda g, u: F.concat(g, F.when(
        u.isNotNull(), F.concat(F.lit("]("), F.regexp_replace(u, WS + "+", ""), F.lit(")")))
        .otherwise(F.lit(""))))
    return F.when(md.isNull(), md).otherwise(F.array_join(pieces, ""))


def strip_link_target_spaces_sql(e: str) -> str:
    gaps = f"regexp_split_to_array({e}, {lit(LINK_TARGET_RE)})"
    targets = f"regexp_extract_all({e}, {lit(LINK_TARGET_RE)}, 1)"
    return (f"(CASE WHEN {e} IS NULL THEN NULL ELSE array_to_string(list_transform({gaps}, "
            f"lambda g, i: g || coalesce('](' || regexp_replace(({targets})[i], {lit(WS + '+')}, '', 'g') "
            f"|| ')', '')), '') END)")


def raw_header(title: Column, url: Column) -> Column:
    """``# title``, blank, ``**URL:** `url` ``, blank, ``---``, newline."""
    return F.concat(F.lit("# "), F.coalesce(title, F.lit(NO_TITLE)), F.lit("\n\n**URL:** `"),
                    F.coalesce(url, F.lit("")), F.lit("`\n\n---\n"))


def raw_header_sql(title: str, url: str) -> str:
    return (f"('# ' || coalesce({title}, {lit(NO_TITLE)}) || chr(10) || chr(10) || '**URL:** `' "
            f"|| coalesce({url}, '') || '`' || chr(10) || chr(10) || '---' || chr(10))")


def clean_header(title: Column, url: Column) -> Column:
    """``Title: t``, ``URL: u``, blank line."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit(NO_TITLE)), F.lit("\nURL: "),
                    F.coalesce(url, F.lit("")), F.lit("\n\n"))


def clean_header_sql(title: str, url: str) -> str:
    return (f"('Title: ' || coalesce({title}, {lit(NO_TITLE)}) || chr(10) || 'URL: ' "
            f"|| coalesce({url}, '') || chr(10) || chr(10))")
