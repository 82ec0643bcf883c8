"""URL scalars: scheme defaulting (B1-B2), RFC 3986 resolution (E4), link class (E5).

Resolution follows ``urllib.parse.urljoin``: absolute ``http(s)://`` targets
stay as they are; a target with another scheme (``mailto:``) is returned
unchanged; ``//host`` keeps the base scheme; an empty target is the base itself; an empty path keeps the base path
(and query when the target has none); other paths are merged with the base
directory and ``.``/``..`` segments removed, empty middle segments of a
relative path dropped.  Without a base, ``/x`` becomes
``https://example.com/x`` and anything else ``https://`` + target.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sqltext import lit
from .text import trim_ws, trim_ws_sql

# --- fixed values: URL grammar pieces and fallbacks ----------------------------
ABSOLUTE_HTTP_RE = "^https?://"
URL_PARTS_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME_RE = "^[A-Za-z][A-Za-z0-9+.-]*:"
NO_BASE_HOST = "https://example.com"
DEFAULT_SCHEME = "https://"


def default_scheme(url: Column) -> Column:
    """B1/B2: trim; blank -> NULL (the row is dropped); add ``https://`` if missing."""
    u = trim_ws(url)
    return (F.when(u.isNull() | (u == ""), F.lit(None).cast("string"))
            .when(u.rlike(ABSOLUTE_HTTP_RE), u)
            .otherwise(F.concat(F.lit(DEFAULT_SCHEME), u)))


def default_scheme_sql(e: str) -> str:
    u = trim_ws_sql(e)
    return (f"(CASE WHEN {u} IS NULL OR {u} = '' THEN NULL "
            f"WHEN regexp_matches({u}, {lit(ABSOLUTE_HTTP_RE)}) THEN {u} "
            f"ELSE {lit(DEFAULT_SCHEME)} || {u} END)")


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, URL_PARTS_RE, i)


def _part_sql(u: str, i: int) -> str:
    return f"regexp_extract({u}, {lit(URL_PARTS_RE)}, {i})"


def resolve_url(target: Column, base: Column) -> Column:
    """The absolute URL a link target points at, seen from page ``base``.

    Schemes count in any case; a target with the base's own scheme is resolved by what follows
    it (``https:c`` is ``c``), as the standard library does.
    """
    b_net, b_path, b_query = (_part(base, i) for i in (2, 3, 4))
    b_scheme = F.lower(_part(base, 1))
    same = F.lower(F.substring_index(target, ":", 1)) == b_scheme
    rest = F.when(same & target.contains(":"), F.substring(target, F.length(b_scheme) + 2, F.length(target))).otherwise(target)
    t_net, t_path, t_query, t_frag = (_part(rest, i) for i in (2, 3, 4, 5))
    t_has_net = rest.startswith("//")

    base_dir = F.split(b_path, "/", -1)
    base_dir = F.when(F.element_at(base_dir, -1) != "",
                      F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(base_dir)
    rel = F.concat(base_dir, F.split(t_path, "/", -1))
    rel = F.when(F.size(rel) >= 2, F.concat(
        F.slice(rel, 1, 1),
        F.filter(F.slice(rel, 2, F.size(rel) - 2), lambda s: s != ""),
        F.slice(rel, -1, 1))).otherwise(rel)
    segs = F.when(t_path.startswith("/"), F.split(t_path, "/", -1)).otherwise(rel)
    stack = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    stack = F.when(F.element_at(segs, -1).isin(".", ".."), F.array_append(stack, F.lit(""))) \
        .otherwise(stack)
    joined = F.array_join(stack, "/")
    merged = (F.when(joined == "", F.lit("/"))
              .when(~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined))

    def tail(query: Column) -> Column:
        return F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
                        F.when(t_frag != "", F.concat(F.lit("#"), t_frag)).otherwise(""))

    prefix = F.concat(b_scheme, F.lit("://"))
    with_base = (
        F.when(target.rlike(SCHEME_RE) & ~same, target)
        .when(t_has_net, F.concat(prefix, t_net, t_path, tail(t_query)))
        .when(t_path == "", F.concat(prefix, b_net, b_path,
                                     tail(F.when(t_query != "", t_query).otherwise(b_query))))
        .otherwise(F.concat(prefix, b_net, merged, tail(t_query)))
    )
    no_base = (F.when(target.startswith("/"), F.concat(F.lit(NO_BASE_HOST), target))
               .otherwise(F.concat(F.lit(DEFAULT_SCHEME), target)))
    return (F.when(target.rlike(ABSOLUTE_HTTP_RE), target)
            .when(base.isNull() | (base == ""), no_base)
            .when(target == "", base)
            .otherwise(with_base))


def resolve_url_sql(target: str, base: str) -> str:
    b_net, b_path, b_query = (_part_sql(base, i) for i in (2, 3, 4))
    b_scheme = f"lower({_part_sql(base, 1)})"
    same = f"(contains({target}, ':') AND lower(split_part({target}, ':', 1)) = {b_scheme})"
    rest = f"(CASE WHEN {same} THEN substr({target}, length({b_scheme}) + 2) ELSE {target} END)"
    t_net, t_path, t_query, t_frag = (_part_sql(rest, i) for i in (2, 3, 4, 5))
    bd = f"string_split({b_path}, '/')"
    base_dir = f"(CASE WHEN ({bd})[-1] <> '' THEN ({bd})[1:len({bd}) - 1] ELSE {bd} END)"
    rel0 = f"list_concat({base_dir}, string_split({t_path}, '/'))"
    rel = (f"(CASE WHEN len({rel0}) >= 2 THEN list_concat(list_concat(({rel0})[1:1], "
           f"list_filter(({rel0})[2:len({rel0}) - 1], lambda s: s <> '')), "
           f"({rel0})[len({rel0}):len({rel0})]) ELSE {rel0} END)")
    segs = f"(CASE WHEN starts_with({t_path}, '/') THEN string_split({t_path}, '/') ELSE {rel} END)"
    stack0 = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[:-2] "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    stack = (f"(CASE WHEN ({segs})[-1] IN ('.', '..') THEN list_append({stack0}, '') "
             f"ELSE {stack0} END)")
    joined = f"array_to_string({stack}, '/')"
    merged = (f"(CASE WHEN {joined} = '' THEN '/' WHEN NOT starts_with({joined}, '/') "
              f"THEN '/' || {joined} ELSE {joined} END)")

    def tail(query: str) -> str:
        return (f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || "
                f"CASE WHEN {t_frag} <> '' THEN '#' || {t_frag} ELSE '' END)")

    prefix = f"({b_scheme} || '://')"
    q = f"(CASE WHEN {t_query} <> '' THEN {t_query} ELSE {b_query} END)"
    with_base = (
        f"(CASE WHEN regexp_matches({target}, {lit(SCHEME_RE)}) AND NOT {same} THEN {target} "
        f"WHEN starts_with({rest}, '//') THEN {prefix} || {t_net} || {t_path} || {tail(t_query)} "
        f"WHEN {t_path} = '' THEN {prefix} || {b_net} || {b_path} || {tail(q)} "
        f"ELSE {prefix} || {b_net} || {merged} || {tail(t_query)} END)")
    no_base = (f"(CASE WHEN starts_with({target}, '/') THEN {lit(NO_BASE_HOST)} || {target} "
               f"ELSE {lit(DEFAULT_SCHEME)} || {target} END)")
    return (f"(CASE WHEN regexp_matches({target}, {lit(ABSOLUTE_HTTP_RE)}) THEN {target} "
            f"WHEN {base} IS NULL OR {base} = '' THEN {no_base} "
            f"WHEN {target} = '' THEN {base} ELSE {with_base} END)")


def link_class(resolved: Column) -> Column:
    """E5: ``mailto`` / ``javascript`` / ``navigate``, decided after resolving."""
    return (F.when(resolved.startswith("mailto:"), "mailto")
            .when(resolved.startswith("javascript:"), "javascript").otherwise("navigate"))


def link_class_sql(e: str) -> str:
    return (f"(CASE WHEN starts_with({e}, 'mailto:') THEN 'mailto' "
            f"WHEN starts_with({e}, 'javascript:') THEN 'javascript' ELSE 'navigate' END)")
