"""HTML as a token relation.

``tokenize`` turns ``pages(page_id, html)`` into one row per token.  The pages
are hash-partitioned by ``page_id`` once, before the explode; every later
window is partitioned by ``page_id`` (plus more keys), which that partitioning
already satisfies, so the whole page pipeline has a single exchange.

``elements`` adds element scopes without a tree: depth is counted per tag name
(so unclosed ``<p>``/``<b>`` cannot break ``<article>``), clamped at zero for
stray closers, and an open tag's matching close is the next token with the same
``(page_id, tag, level)``.  Element text length is a difference of running
text-length sums.
"""

from __future__ import annotations

from functools import cache
from string import ascii_letters

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import (
    ATTR_RE,
    IMPLIED_ENDS,
    PLAIN_ENDS,
    PLAIN_STARTS,
    RAW_RE,
    RAW_TAGS,
    RAW_TEXT_RE,
    SELF_CLOSING_RE,
    TEXT_RAW_TAGS,
    TOKEN_RE_JAVA,
    VOID_TAGS,
    WS,
)
from ..functions.text import decode_entities, trim_ws

_NAME_RE = r"""^[^\s"'>/=]+"""

TOKEN_COLUMNS = ["page_id", "pos", "tok", "kind", "tag", "sign", "text", "tlen", "attrs"]


def token_kind(tok: Column) -> Column:
    # Looks at the first characters; a regex runs only on what may be a raw element.
    at = lambda i, n=1: F.substring(tok, i, n)
    raw = F.lower(at(2, 2)).isin(*sorted({t[:2] for t in RAW_TAGS})) & tok.rlike(RAW_RE)
    return (
        F.when(~tok.startswith("<"), "text")
        .when(tok.isin(*PLAIN_STARTS), "start")
        .when(tok.isin(*PLAIN_ENDS), "end")
        .when(tok.startswith("<!--"), "comment")
        .when(raw, "raw")
        .when(tok.startswith("</") & at(3).isin(*ascii_letters), "end")
        .when(at(2).isin(*ascii_letters), "start")
        .when(at(2).isin("!", "?", "/"), "decl")
        .otherwise("text")
    )


def tag_name(tok: Column, end: Column) -> Column:
    """Lower-cased name of a tag (``end``: of an end tag): what comes before the first space, ``/`` or ``>``."""
    name = F.substring(tok, F.when(end, 3).otherwise(2), F.length(tok))
    for stop in ">/ \n\t\r\f\v":
        name = F.substring_index(name, stop, 1)
    return F.lower(name)


def attr_value(attrs: Column | str, name: str) -> Column:
    """Value of the first attribute called ``name`` (NULL when absent).

    ``attrs`` (a column name, or ``F.col`` of one) is the list of raw
    ``name=value`` strings of a start tag; the first occurrence of a duplicated
    name wins.
    """
    if isinstance(attrs, Column):
        return _attr_value(attrs, name)
    return _attr_value_named(attrs, name)


@cache
def _attr_value_named(attrs: str, name: str) -> Column:
    # Expressions depend only on column names, so they are built once per process.
    return _attr_value(F.col(attrs), name)


def _attr_value(attrs: Column, name: str) -> Column:
    # Each step is a transform of the one hit, so that what a step makes is computed once however
    # often the next one names it; other names are told apart without a regex.
    hit = F.filter(attrs, lambda a: (F.lower(F.substring(a, 1, len(name))) == name) & (attr_name(a) == name))
    value = F.transform(F.transform(F.slice(hit, 1, 1), _raw_value), _unquoted)
    return F.get(F.transform(value, lambda v: decode_entities(v, attribute=True)), 0)


def attr_name(a: Column) -> Column:
    """Lower-cased name of a raw ``name=value`` attribute string."""
    return F.lower(F.regexp_extract(a, _NAME_RE, 0))


def attr_pair_value(a: Column) -> Column:
    """Unquoted, entity-decoded value of a raw attribute ('' when it has none)."""
    return decode_entities(_unquoted(_raw_value(a)), attribute=True)


def _raw_value(a: Column) -> Column:
    return F.regexp_extract(a, r"(?s)^[^=]*=\s*(.*)$", 1)


def _unquoted(v: Column) -> Column:
    n = F.length(v)
    quoted = (n >= 2) & (
        (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
    )
    return F.when(quoted, F.substring(v, F.lit(2), n - 2)).otherwise(v)


PAGE_PARTITIONS_CONF = "weftview.pagePartitions"

#: HTML of one partition.  A sort of its token rows takes about 20 times that, and a plan holds several.
PARTITION_BYTES = 4 << 20


def page_partitions(df: DataFrame) -> int:
    """Partitions for the page shuffle.

    Tokenising is CPU-bound per byte of HTML, so the count is fixed rather than
    left to AQE (which sizes partitions by bytes and would merge a small-in-
    bytes, heavy-in-CPU stage into a few tasks): ``weftview.pagePartitions``
    if set, else ``max(2 x defaultParallelism, spark.sql.shuffle.partitions)``,
    or one per ``PARTITION_BYTES`` of HTML where that is more, so that a task's
    token sorts stay in memory however many pages there are (the bytes are
    summed in a job of its own; a stream's are not known).
    A repartition by number is not coalesced by AQE.
    """
    spark = df.sparkSession
    conf = spark.conf.get(PAGE_PARTITIONS_CONF, None)
    if conf:
        return int(conf)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    least = max(2 * spark.sparkContext.defaultParallelism, shuffle)
    if df.isStreaming:
        return least
    total = df.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    return max(least, -(-total // PARTITION_BYTES))


def tokenize(pages: DataFrame, partitions: int | None = None, with_url: bool = False,
             placed: bool = False) -> DataFrame:
    """``pages(page_id, html)`` -> tokens, hash-partitioned by ``page_id``.

    Columns: ``page_id, pos`` (0-based), ``tok``, ``kind`` (start, end, raw,
    text, comment, decl), ``tag`` (lower case), ``sign`` (+1 opens a scope,
    -1 closes one, 0 otherwise), ``text`` (entity-decoded text of a text token
    or of a raw ``<title>`` or ``<textarea>``), ``tlen`` (length of the stripped text) and
    ``attrs`` (raw attribute strings of a start tag).

    ``with_url``: ``pages`` also has ``url``; it travels through the page
    shuffle on each page's first row only (NULL elsewhere), and a page without
    tokens keeps one row with NULL ``pos``/``tok``, so per-page aggregates see
    every page and need no join back to ``pages`` for the URL.

    ``placed``: ``pages`` is partitioned by ``page_id`` already (a table of ``sources.crawl``) and
    is not shuffled.  Pages that are not give the same result: Spark then shuffles their tokens.
    """
    p = pages.select(*(["page_id", "url", "html"] if with_url else ["page_id", "html"]))
    if not placed:
        p = p.repartition(partitions or page_partitions(pages), "page_id")
    toks = F.regexp_extract_all("html", F.lit(TOKEN_RE_JAVA), 0)
    if with_url:
        t = p.select("page_id", "url", F.posexplode_outer(toks).alias("pos", "tok"))
        t = t.withColumn("url", F.when(F.col("pos").isNull() | (F.col("pos") == 0), F.col("url")))
    else:
        t = p.select("page_id", F.posexplode(toks).alias("pos", "tok"))
    e = _token_exprs()
    t = t.withColumn("kind", e["kind"])
    t = t.withColumn("tag", e["tag"])
    t = t.withColumns({"sign": e["sign"], "text": e["text"], "attrs": e["attrs"]})
    t = t.withColumn("tlen", e["tlen"])
    return t.select(*TOKEN_COLUMNS, *(["url"] if with_url else []))


@cache
def _token_exprs() -> dict[str, Column]:
    """Column expressions of ``tokenize``, built once per process."""
    tok, kind, tag = F.col("tok"), F.col("kind"), F.col("tag")
    out = {"kind": token_kind(tok)}
    plain = tok.isin(*PLAIN_STARTS)
    out["tag"] = F.when(plain | tok.isin(*PLAIN_ENDS), F.btrim(tok, F.lit("</>"))).when(
        kind.isin("start", "end", "raw"), tag_name(tok, kind == "end"))
    out.update({
        "sign": F.when((kind == "start") & ~tag.isin(*VOID_TAGS) & ~(tok.contains("/>") & tok.rlike(SELF_CLOSING_RE)), 1)
        .when((kind == "end") & ~tag.isin(*VOID_TAGS), -1)
        .otherwise(0),
        "text": F.when(kind == "text", decode_entities(tok)).when(
            (kind == "raw") & tag.isin(*TEXT_RAW_TAGS), decode_entities(F.regexp_extract(tok, RAW_TEXT_RE, 1)),
        ),
        "attrs": F.when(plain, F.array().cast("array<string>")).when(
                        kind == "start",
                        F.regexp_extract_all(F.regexp_replace(tok, r"^<[A-Za-z][^\s/>]*", ""),
                                             F.lit(ATTR_RE), 0)),
    })
    out["tlen"] = F.coalesce(F.length(trim_ws(F.col("text"))), F.lit(0)).cast("long")
    return out


@cache
def _element_stages(carry: tuple[str, ...]) -> list[dict[str, Column]]:
    """The column stages of ``elements`` (each may use the ones before); built once."""
    w_page = Window.partitionBy("page_id").orderBy("pos")
    upto = w_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_tag = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_lvl = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    # from the page's end: the nearest event after a token, at its level of closed elements
    w_next = (Window.partitionBy("page_id", "_in").orderBy(F.col("pos").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    sign, tag = F.col("sign"), F.col("tag")
    nxt_close = (sign == 1) & (F.lead("sign").over(w_lvl) == -1)
    prv_open = (sign == -1) & (F.lag("sign").over(w_lvl) == 1)
    here = F.struct(F.col("pos").alias("p"), F.col("cum").alias("c"))
    nearest = lambda cond: F.last(F.when(cond, here), ignorenulls=True).over(w_next)
    groups = implied_end_groups()
    sibling = F.lit(None)
    for i, (tags, _) in enumerate(groups):
        sibling = F.when(tag.isin(*tags), F.col(f"_sib{i}")).otherwise(sibling)
    return [
        {
            "cum": F.sum("tlen").over(upto) - F.col("tlen"),
            "total": F.sum("tlen").over(whole),
            "n_tokens": F.max("pos").over(whole) + 1,
            "next_kind": F.lead("kind").over(w_page),
            "next_text": F.lead("text").over(w_page),
        },
        {"s": F.sum("sign").over(w_tag)},
        {"depth": F.col("s") - F.least(F.lit(0), F.min("s").over(w_tag))},
        {"level": F.when(sign == 1, F.col("depth")).when(sign == -1, F.col("depth") + 1)},
        {
            "close_pos": F.when(nxt_close, F.lead("pos").over(w_lvl)),
            "close_cum": F.when(nxt_close, F.lead("cum").over(w_lvl)),
            "open_pos": F.when(prv_open, F.lag("pos").over(w_lvl)),
            **{f"open_{c}": F.when(prv_open, F.lag(c).over(w_lvl)) for c in carry},
        },
        # elements with both tags that hold the token (a close tag lies inside its own element)
        {"_pair": F.when(F.col("close_pos").isNotNull(), 1).when(F.col("open_pos").isNotNull(), -1).otherwise(0)},
        {"_in": F.sum("_pair").over(upto) - F.col("_pair")},
        {"_parent": nearest(F.col("_pair") == -1),
         **{f"_sib{i}": nearest(F.col("kind").isin("start", "raw") & tag.isin(*ends))
            for i, (_, ends) in enumerate(groups)}},
        {"_end": F.when((sign == 1) & F.col("close_pos").isNull(), F.least(F.col("_parent"), sibling))},
        {
            "end_pos": F.when(F.col("close_pos").isNotNull(), F.col("close_pos") + 1)
            .when(sign == 1, F.coalesce(F.col("_end.p"), F.col("n_tokens")))
            .when(F.col("kind").isin("start", "raw"), F.col("pos") + 1),
            "elem_len": F.when(sign == 1, F.coalesce(F.col("close_cum"), F.col("_end.c"), F.col("total"))
                               - F.col("cum"))
            .when(F.col("kind").isin("start", "raw"), F.col("tlen")),
        },
    ]


def implied_end_groups() -> list[tuple[list[str], tuple[str, ...]]]:
    """``IMPLIED_ENDS`` by what ends them: (elements, start tags that end them)."""
    by_ends: dict[tuple[str, ...], list[str]] = {}
    for tag, ends in IMPLIED_ENDS.items():
        by_ends.setdefault(ends, []).append(tag)
    return [(tags, ends) for ends, tags in by_ends.items()]


def with_selector_attrs(t: DataFrame) -> DataFrame:
    """Add the attributes that selectors test: class (and its names), role,
    aria-hidden, itemtype."""
    attrs, classes = _selector_attr_exprs()
    return t.withColumns(attrs).withColumns(classes)


@cache
def _selector_attr_exprs() -> tuple[dict[str, Column], dict[str, Column]]:
    attrs = {
        "a_class": attr_value("attrs", "class"),
        "a_role": attr_value("attrs", "role"),
        "a_aria_hidden": attr_value("attrs", "aria-hidden"),
        "a_itemtype": attr_value("attrs", "itemtype"),
    }
    # Class names split once; each class selector is then an array_contains.
    return attrs, {"a_classes": F.split(trim_ws(F.col("a_class")), WS + "+", -1)}


def elements(t: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add scope columns to every token.

    ``cum`` text length before the token, ``total`` page text length,
    ``n_tokens`` tokens of the page, ``next_text`` text of the following token,
    ``depth`` clamped per-tag depth, ``level`` scope level of an open/close tag,
    for open tags ``close_pos`` (NULL = never closed), ``end_pos`` (first token
    that is no longer in the element) and ``elem_len``, for close tags
    ``open_pos`` of the tag they close and, for each column named in ``carry``,
    ``open_<name>``: that column's value on the open tag.

    An element that is never closed ends where its parent (the innermost
    element with both tags around it) closes, or before the sibling start tag
    that implies its end (``IMPLIED_ENDS``), or with the page.
    """
    for stage in _element_stages(tuple(carry)):
        t = t.withColumns(stage)
    return t.drop("s", "close_cum", "_pair", "_in", "_parent", "_end",
                  *(f"_sib{i}" for i in range(len(implied_end_groups()))))
