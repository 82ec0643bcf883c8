"""Markdown links as rows.

Links are taken with ``regexp_extract_all``; a match's offset is the running
sum of the text between matches (``split`` on the same pattern) and the
matches before it, computed by a window over the document, so a page with many
links stays linear.  The documents arrive grouped by their key, so the window
reuses that partitioning.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import LINK_RE
from ..functions.text import trim_ws


def raw_link_matches(docs: DataFrame, key, md: str) -> DataFrame:
    """One row per regex match: ``key, i, text, target, start_pos, end_pos``.

    ``text``/``target`` are the raw groups; offsets are 0-based code points,
    ``end_pos`` exclusive (Python ``match.start()``/``match.end()``).
    """
    keys = (key,) if isinstance(key, str) else tuple(key)
    gen, out = _match_exprs(keys, md)
    z = docs.select(*keys, gen).where(F.col("z.whole").isNotNull())
    return z.select(*keys, *out)


@cache
def _match_exprs(keys: tuple[str, ...], md: str) -> tuple[Column, list[Column]]:
    """Expressions of ``raw_link_matches`` (names only, so built once per process)."""
    m = F.col(md)
    gen = F.posexplode(F.arrays_zip(
        F.regexp_extract_all(m, F.lit(LINK_RE), 0).alias("whole"),
        F.regexp_extract_all(m, F.lit(LINK_RE), 1).alias("text"),
        F.regexp_extract_all(m, F.lit(LINK_RE), 2).alias("target"),
        F.split(m, LINK_RE, -1).alias("gap"),
    )).alias("i", "z")
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.length("z.gap") + F.length("z.whole")
    start = F.sum(step).over(w) - F.length("z.whole")
    out = [F.col("i").cast("long").alias("i"), F.col("z.text").alias("text"),
           F.col("z.target").alias("target"), start.cast("long").alias("start_pos"),
           (start + F.length("z.whole")).cast("long").alias("end_pos")]
    return gen, out


def clean_links(matches: DataFrame, key) -> DataFrame:
    """Trim, unwrap ``<...>``, skip empty / ``#`` / ``vote?`` / ``from?site=``.

    Adds ``link_idx``: the 0-based position among the links that remain.
    """
    keys = (key,) if isinstance(key, str) else tuple(key)
    cleaned, keep, idx = _clean_exprs(keys)
    x = matches.withColumns(cleaned).where(keep)
    return x.withColumn("link_idx", idx).drop("i")


@cache
def _clean_exprs(keys: tuple[str, ...]) -> tuple[dict[str, Column], Column, Column]:
    unwrapped, _ = _kept(F.col("target"))
    u = F.col("target")
    keep = ~((u == "") | u.startswith("#") | u.contains("vote?") | u.startswith("from?site="))
    idx = (F.row_number().over(Window.partitionBy(*keys).orderBy("i")) - 1).cast("long")
    return {"text": trim_ws(F.col("text")), "target": unwrapped}, keep, idx


def extract_links(docs: DataFrame, key, md: str) -> DataFrame:
    """``key..., link_idx, text, target, start_pos, end_pos``."""
    keys = [key] if isinstance(key, str) else list(key)
    return clean_links(raw_link_matches(docs, keys, md), keys).select(
        *keys, "link_idx", "text", "target", "start_pos", "end_pos")


def link_ring(links: DataFrame, key: str) -> DataFrame:
    """Next / previous link from every selection state, wrapping round.

    One row per current index ``cur_idx`` in ``-1 .. n-1`` (-1 = nothing
    selected): ``next_idx = (cur+1) mod n``, ``prev_idx = (cur-1) mod n`` with
    Python's non-negative modulo (so from -1, previous is ``n-2 mod n``).
    """
    w = Window.partitionBy(key).orderBy("link_idx")
    w_all = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(w_all)
    x = links.select(
        key, "link_idx", "target",
        n.alias("n"),
        F.coalesce(F.lead("target").over(w), F.first("target").over(w_all)).alias("next_url"),
        F.coalesce(F.lag("target").over(w), F.last("target").over(w_all)).alias("prev_url"),
        F.first("target").over(w_all).alias("first_url"),
    )
    body = F.struct(F.col("link_idx").alias("cur_idx"),
                    F.pmod(F.col("link_idx") + 1, F.col("n")).cast("long").alias("next_idx"),
                    F.pmod(F.col("link_idx") - 1, F.col("n")).cast("long").alias("prev_idx"),
                    F.col("next_url").alias("next_url"), F.col("prev_url").alias("prev_url"))
    # The start state reads the link at n-2 (mod n): the last link's predecessor.
    # It is emitted next to the last link's row, so the links are computed once.
    start = F.struct(F.lit(-1).cast("long").alias("cur_idx"), F.lit(0).cast("long").alias("next_idx"),
                     F.pmod(F.lit(-2), F.col("n")).cast("long").alias("prev_idx"),
                     F.col("first_url").alias("next_url"),
                     F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("prev_url"))
                     .alias("prev_url"))
    rows = F.filter(F.array(body, F.when(F.col("link_idx") == F.col("n") - 1, start)),
                    lambda r: r.isNotNull())
    out = x.select(key, F.explode(rows).alias("r"))
    return out.select(key, "r.cur_idx", "r.next_idx", "r.prev_idx", "r.next_url", "r.prev_url")


def highlight(md: Column, text: Column, target: Column, start: Column, end: Column) -> Column:
    """Replace the link span with ``**→ [text](url) ←**``; no link = unchanged."""
    marked = F.concat(F.substring(md, F.lit(1), start), F.lit("**→ ["), text, F.lit("]("), target,
                      F.lit(") ←**"), F.substring(md, end + 1, F.length(md)))
    return F.when(start.isNull(), md).otherwise(marked)


def _kept(target: Column) -> tuple[Column, Column]:
    """E2/E3 on a raw target group: trim, unwrap ``<...>``, then the skip rules."""
    t = trim_ws(target)
    u = F.when(t.startswith("<") & t.endswith(">"),
               F.when(F.length(t) >= 2, F.substring(t, F.lit(2), F.length(t) - 2))
               .otherwise(F.lit(""))).otherwise(t)
    return u, ~((u == "") | u.startswith("#") | u.contains("vote?") | u.startswith("from?site="))


def link_count(md: Column) -> Column:
    """Number of links E1-E3 keep in a document, computed inside the row."""
    targets = F.regexp_extract_all(md, F.lit(LINK_RE), 2)
    return F.size(F.filter(F.transform(targets, lambda u: _kept(u)[1]), lambda k: k)).cast("long")


def highlight_nth(md: Column, k: Column) -> Column:
    """The document with its k-th link (from 0) marked; unchanged if there is none.

    Computed inside the row: the k-th match that survives E2/E3, its offset from the lengths of
    the text and matches before it.  No join with the link rows is needed.
    """
    whole = F.regexp_extract_all(md, F.lit(LINK_RE), 0)
    texts = F.regexp_extract_all(md, F.lit(LINK_RE), 1)
    targets = F.regexp_extract_all(md, F.lit(LINK_RE), 2)
    gaps = F.split(md, LINK_RE, -1)
    kept = F.filter(F.transform(targets, lambda u, i: F.when(_kept(u)[1], i)), lambda i: i.isNotNull())
    i = F.get(kept, k)
    lens = lambda arr: F.aggregate(arr, F.lit(0), lambda acc, x: acc + F.length(x))
    start = lens(F.slice(gaps, F.lit(1), i + 1)) + lens(F.slice(whole, F.lit(1), i))
    end = start + F.length(F.get(whole, i))
    u, _ = _kept(F.get(targets, i))
    marked = highlight(md, trim_ws(F.get(texts, i)), u, start, end)
    return F.when(i.isNotNull(), marked).otherwise(md)
