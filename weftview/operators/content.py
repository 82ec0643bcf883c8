"""Structure of a page: selectors, title, main content, noise removal.

All operators work on the token relation from ``tokens.tokenize`` and only add
window columns partitioned by ``page_id``; no extra exchange is planned.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import (
    CONTENT_SELECTORS,
    MAIN_MIN_CHARS,
    MAIN_NOISE_SELECTORS,
    NO_TITLE,
    PAGE_NOISE_SELECTORS,
    WS,
)
from ..functions.sqltext import rx_escape
from ..functions.text import trim_ws
from .tokens import attr_value, elements, with_selector_attrs

_ATTR_SEL = re.compile(r"^\[([A-Za-z-]+)(\*?)='([^']*)'\]$")
_ATTR_COL = {"class": "a_class", "role": "a_role", "aria-hidden": "a_aria_hidden",
             "itemtype": "a_itemtype"}


def parse_selector(sel: str) -> tuple[str, str, str]:
    """Simple selector -> (kind, name, value); kinds: tag, class, eq, contains."""
    if sel.startswith("."):
        return ("class", sel[1:], "")
    m = _ATTR_SEL.match(sel)
    if m:
        return ("contains" if m.group(2) else "eq", m.group(1), m.group(3))
    return ("tag", sel.lower(), "")


def class_pattern(name: str) -> str:
    return f"(^|{WS}){rx_escape(name)}({WS}|$)"


def selector_predicate(sel: str) -> Column:
    """Column predicate that is true on an element token matching ``sel``."""
    kind, name, value = parse_selector(sel)
    if kind == "tag":
        return F.col("tag") == name
    if kind == "class":
        return F.coalesce(F.array_contains(F.col("a_classes"), name), F.lit(False))
    col = F.col(_ATTR_COL[name])
    if kind == "eq":
        return F.coalesce(col == value, F.lit(False))
    return F.coalesce(col.contains(value), F.lit(False))


@cache
def any_selector(sels: tuple[str, ...]) -> Column:
    is_elem = F.col("kind").isin("start", "raw")
    pred = F.lit(False)
    for s in sels:
        pred = pred | selector_predicate(s)
    return is_elem & pred


@cache
def content_rank(sels: tuple[str, ...] = CONTENT_SELECTORS) -> Column:
    """1-based rank of the first content selector an element matches, else NULL."""
    is_elem = F.col("kind").isin("start", "raw")
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sels, start=1))):
        rank = F.when(selector_predicate(s), F.lit(i)).otherwise(rank)
    return F.when(is_elem, rank)


def page_structure(tokens: DataFrame) -> DataFrame:
    """Tokens with scopes, main content and both noise levels.

    Adds ``main_pos``/``main_end``/``main_tag``/``main_len`` (NULL when no
    element passes: the whole-page branch), ``in_main_noise``,
    ``in_page_noise`` and ``keep`` (the token survives cleaning).
    """
    first, after = _structure_stages()
    t = with_selector_attrs(tokens).withColumns(first)
    # The raw token and its attribute list are not needed past this point;
    # dropping them keeps every later sort narrow.
    t = t.drop("tok", "attrs", "a_class", "a_classes", "a_role", "a_aria_hidden", "a_itemtype")
    t = elements(t, carry=("a_href",))
    for stage in after:
        t = t.withColumns(stage)
        if "main_pos" in stage:
            t = t.drop("best")
    return t.drop("m_end", "p_end")


@cache
def _structure_stages() -> tuple[dict[str, Column], list[dict[str, Column]]]:
    """Column stages of ``page_structure`` (before and after ``elements``); built once."""
    tag = F.col("tag")
    first = {
        "rank": content_rank(),
        "m_noise": any_selector(MAIN_NOISE_SELECTORS),
        "p_noise": any_selector(PAGE_NOISE_SELECTORS),
        "a_href": F.when(tag == "a", attr_value("attrs", "href")),
        "a_src": F.when(tag == "img", attr_value("attrs", "src")),
        "a_alt": F.when(tag == "img", attr_value("attrs", "alt")),
    }
    # Main content: lowest rank, then longest text, then first in the page.
    w_all = Window.partitionBy("page_id")
    best = F.min(F.when(
        F.col("rank").isNotNull() & (F.col("elem_len") > MAIN_MIN_CHARS),
        F.struct(F.col("rank").alias("r"), (-F.col("elem_len")).alias("nl"),
                 F.col("pos").alias("p"), F.col("end_pos").alias("e"),
                 F.col("tag").alias("g")),
    )).over(w_all)
    main = {
        "main_pos": F.col("best.p"),
        "main_end": F.col("best.e"),
        "main_tag": F.col("best.g"),
        "main_len": -F.col("best.nl"),
    }
    # A token is noise if a noise element at or before it ends after it.
    sign, pos = F.col("sign"), F.col("pos")
    in_main = F.col("main_pos").isNotNull() & (pos >= F.col("main_pos"))
    ends = {
        "m_end": F.when(F.col("m_noise") & in_main, F.col("end_pos")),
        "p_end": F.when(F.col("p_noise"), F.col("end_pos")),
    }
    upto = (Window.partitionBy("page_id").orderBy("pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    noise = {
        "in_main_noise": F.coalesce(F.max("m_end").over(upto) > pos, F.lit(False)),
        "in_page_noise": F.coalesce(F.max("p_end").over(upto) > pos, F.lit(False)),
    }
    keep = {"keep": F.when(
        F.col("main_pos").isNotNull(),
        (pos >= F.col("main_pos")) & (pos < F.col("main_end")) & ~F.col("in_main_noise"))
        .otherwise(~F.col("in_page_noise"))}
    return first, [{"best": best}, main, ends, noise, keep]


@cache
def title_text() -> Column:
    """Text of a ``<title>`` token: inner text of a closed one, else the next text."""
    return trim_ws(
        F.when(F.col("kind") == "raw", F.col("text"))
        .when(F.col("next_kind") == "text", F.col("next_text"))
        .otherwise(F.lit(""))
    )


@cache
def is_title_candidate() -> Column:
    """A ``<title>`` the page title may come from.

    With main content the original tree is searched; in the whole-page branch
    the title is looked up after noise removal, so one inside noise is skipped.
    """
    return ((F.col("tag") == "title") & F.col("kind").isin("raw", "start")
            & (F.col("main_pos").isNotNull() | ~F.col("in_page_noise")))


@cache
def page_title_agg(whole_page: bool = False) -> Column:
    """Aggregate: first title candidate's text, else ``No Title``.

    ``whole_page``: any ``<title>`` of the page counts (the raw view).
    """
    any_title = (F.col("tag") == "title") & F.col("kind").isin("raw", "start")
    first = F.min(F.when(any_title if whole_page else is_title_candidate(),
                         F.struct(F.col("pos").alias("p"), title_text().alias("t"))))
    return F.coalesce(first.getField("t"), F.lit(NO_TITLE))
