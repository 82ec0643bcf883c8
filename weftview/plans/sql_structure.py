"""DuckDB SQL for the token relation and page structure (the oracle side).

The same computation as ``operators.tokens`` / ``operators.content`` written as
plain SQL over the pre-registered ``pages`` view: window functions for scopes,
main content and noise levels.  Used only by ``oracle_sql()``.
"""

from __future__ import annotations

from ..functions.patterns import (
    ATTR_RE,
    CONTENT_SELECTORS,
    MAIN_MIN_CHARS,
    MAIN_NOISE_SELECTORS,
    NO_TITLE,
    PAGE_NOISE_SELECTORS,
    RAW_RE,
    RAW_TEXT_RE,
    SELF_CLOSING_RE,
    TEXT_RAW_TAGS,
    TOKEN_RE_RE2,
    VOID_TAGS,
)
from ..functions.sqltext import lit
from ..functions.text import decode_entities_sql, trim_ws_sql
from ..operators.content import class_pattern, parse_selector
from ..operators.tokens import implied_end_groups

_NAME_RE = r"""^[^\s"'>/=]+"""
_VOIDS = ", ".join(lit(v) for v in VOID_TAGS)
_ATTR_COL = {"class": "a_class", "role": "a_role", "aria-hidden": "a_aria_hidden",
             "itemtype": "a_itemtype"}


def attr_pair_value_sql(a: str) -> str:
    v = f"regexp_extract({a}, '(?s)^[^=]*=\\s*(.*)$', 1)"
    quoted = (f"(length({v}) >= 2 AND ((starts_with({v}, '\"') AND ends_with({v}, '\"')) "
              f"OR (starts_with({v}, '''') AND ends_with({v}, ''''))))")
    return decode_entities_sql(f"(CASE WHEN {quoted} THEN substr({v}, 2, length({v}) - 2) ELSE {v} END)", attribute=True)


def attr_name_sql(a: str) -> str:
    return f"lower(regexp_extract({a}, {lit(_NAME_RE)}, 0))"


def attr_value_sql(attrs: str, name: str) -> str:
    hit = f"list_filter({attrs}, lambda a: {attr_name_sql('a')} = {lit(name)})[1]"
    return f"(CASE WHEN {hit} IS NOT NULL THEN {attr_pair_value_sql(hit)} END)"


def selector_sql(sel: str) -> str:
    kind, name, value = parse_selector(sel)
    if kind == "tag":
        return f"coalesce(tag = {lit(name)}, false)"
    if kind == "class":
        return f"coalesce(regexp_matches(a_class, {lit(class_pattern(name))}), false)"
    col = _ATTR_COL[name]
    if kind == "eq":
        return f"coalesce({col} = {lit(value)}, false)"
    return f"coalesce(contains({col}, {lit(value)}), false)"


def any_selector_sql(sels) -> str:
    return "(kind IN ('start', 'raw') AND (" + " OR ".join(selector_sql(s) for s in sels) + "))"


def content_rank_sql() -> str:
    arms = " ".join(f"WHEN {selector_sql(s)} THEN {i}" for i, s in enumerate(CONTENT_SELECTORS, 1))
    return f"(CASE WHEN kind IN ('start', 'raw') THEN (CASE {arms} END) END)"


def tokens_ctes(src: str = "pages") -> str:
    """CTEs ending in ``tokens(page_id, pos, tok, kind, tag, sign, text, tlen, attrs)``."""
    text_raw = ", ".join(lit(t) for t in TEXT_RAW_TAGS)
    text = (f"CASE WHEN kind = 'text' THEN {decode_entities_sql('tok')} "
            f"WHEN kind = 'raw' AND tag IN ({text_raw}) THEN "
            f"{decode_entities_sql(lit_re_extract('tok'))} END")
    return f"""
tk0 AS (SELECT page_id, regexp_extract_all(html, {lit(TOKEN_RE_RE2)}, 0) AS toks FROM {src}),
tk1 AS (SELECT page_id, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM tk0),
tk2 AS (SELECT page_id, pos, tok,
  CASE WHEN starts_with(tok, '<!--') THEN 'comment'
       WHEN regexp_matches(tok, {lit(RAW_RE)}) THEN 'raw'
       WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'end'
       WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'start'
       WHEN regexp_matches(tok, '^<[!?/]') THEN 'decl'
       ELSE 'text' END AS kind
  FROM tk1),
tk3 AS (SELECT *, CASE WHEN kind IN ('start', 'end', 'raw')
  THEN lower(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1)) END AS tag FROM tk2),
tk4 AS (SELECT page_id, pos, tok, kind, tag,
  CASE WHEN kind = 'start' AND tag NOT IN ({_VOIDS}) AND NOT regexp_matches(tok, {lit(SELF_CLOSING_RE)}) THEN 1
       WHEN kind = 'end' AND tag NOT IN ({_VOIDS}) THEN -1 ELSE 0 END AS sign,
  {text} AS text,
  CASE WHEN kind = 'start' THEN regexp_extract_all(
       regexp_replace(tok, '^<[A-Za-z][^\\s/>]*', ''), {lit(ATTR_RE)}, 0) END AS attrs
  FROM tk3),
tokens AS (SELECT *, coalesce(length({trim_ws_sql('text')}), 0) AS tlen FROM tk4)"""


def lit_re_extract(e: str) -> str:
    return f"regexp_extract({e}, {lit(RAW_TEXT_RE)}, 1)"


def elements_ctes(src: str = "tokens", carry: tuple[str, ...] = ()) -> str:
    """CTEs ending in ``elements``: scope columns as in ``operators.tokens.elements``."""
    w_lvl = "(PARTITION BY page_id, tag, level ORDER BY pos)"
    groups = implied_end_groups()
    in_list = lambda tags: "tag IN (" + ", ".join(lit(t) for t in tags) + ")"
    siblings = ",\n  ".join(_nearest(f"kind IN ('start', 'raw') AND {in_list(ends)}") + f" AS sib{i}"
                           for i, (_, ends) in enumerate(groups))
    sibling = "(CASE " + " ".join(f"WHEN {in_list(tags)} THEN sib{i}" for i, (tags, _) in enumerate(groups)) + " END)"
    carried = "".join(
        f",\n  CASE WHEN sign = -1 AND lag(sign) OVER {w_lvl} = 1 THEN lag({c}) OVER {w_lvl} END AS open_{c}"
        for c in carry)
    return f"""
el1 AS (SELECT *,
  sum(tlen) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tlen AS cum,
  sum(tlen) OVER (PARTITION BY page_id) AS total,
  max(pos) OVER (PARTITION BY page_id) + 1 AS n_tokens,
  lead(kind) OVER (PARTITION BY page_id ORDER BY pos) AS next_kind,
  lead(text) OVER (PARTITION BY page_id ORDER BY pos) AS next_text,
  sum(sign) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM {src}),
el2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, tag ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM el1),
el3 AS (SELECT *, CASE WHEN sign = 1 THEN depth WHEN sign = -1 THEN depth + 1 END AS level FROM el2),
el4 AS (SELECT *,
  CASE WHEN sign = 1 AND lead(sign) OVER {w_lvl} = -1 THEN lead(pos) OVER {w_lvl} END AS close_pos,
  CASE WHEN sign = 1 AND lead(sign) OVER {w_lvl} = -1 THEN lead(cum) OVER {w_lvl} END AS close_cum,
  CASE WHEN sign = -1 AND lag(sign) OVER {w_lvl} = 1 THEN lag(pos) OVER {w_lvl} END AS open_pos{carried}
  FROM el3),
el5 AS (SELECT *, CASE WHEN close_pos IS NOT NULL THEN 1 WHEN open_pos IS NOT NULL THEN -1 ELSE 0 END AS pair FROM el4),
el6 AS (SELECT *, sum(pair) OVER (PARTITION BY page_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - pair AS within FROM el5),
el7 AS (SELECT *, {_nearest("pair = -1")} AS parent,
  {siblings} FROM el6),
el8 AS (SELECT *, CASE WHEN sign = 1 AND close_pos IS NULL THEN
  CASE WHEN parent IS NULL THEN {sibling} WHEN {sibling} IS NULL THEN parent
       WHEN parent.p <= {sibling}.p THEN parent ELSE {sibling} END END AS fin FROM el7),
elements AS (SELECT *,
  CASE WHEN close_pos IS NOT NULL THEN close_pos + 1 WHEN sign = 1 THEN coalesce(fin.p, n_tokens)
       WHEN kind IN ('start', 'raw') THEN pos + 1 END AS end_pos,
  CASE WHEN sign = 1 THEN coalesce(close_cum, fin.c, total) - cum
       WHEN kind IN ('start', 'raw') THEN tlen END AS elem_len
  FROM el8)"""


def _nearest(cond: str) -> str:
    """The next token after this one, at its level of closed elements, for which ``cond`` holds."""
    return (f"last_value(CASE WHEN {cond} THEN {{'p': pos, 'c': cum}} END IGNORE NULLS) OVER "
            "(PARTITION BY page_id, within ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def structure_ctes() -> str:
    """CTEs ending in ``structure``: tokens with main content, noise and ``keep``."""
    sel_attrs = ",\n  ".join(f"{attr_value_sql('attrs', n)} AS {c}" for n, c in _ATTR_COL.items())
    best = ("min(CASE WHEN rank IS NOT NULL AND elem_len > " + str(MAIN_MIN_CHARS) +
            " THEN {'r': rank, 'nl': -elem_len, 'p': pos, 'e': end_pos, 'g': tag} END)"
            " OVER (PARTITION BY page_id)")
    w_run = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return tokens_ctes() + f""",
sa AS (SELECT *,
  {sel_attrs}
  FROM tokens),
sb AS (SELECT *, {content_rank_sql()} AS rank,
  {any_selector_sql(MAIN_NOISE_SELECTORS)} AS m_noise,
  {any_selector_sql(PAGE_NOISE_SELECTORS)} AS p_noise,
  CASE WHEN tag = 'a' THEN {attr_value_sql('attrs', 'href')} END AS a_href,
  CASE WHEN tag = 'img' THEN {attr_value_sql('attrs', 'src')} END AS a_src,
  CASE WHEN tag = 'img' THEN {attr_value_sql('attrs', 'alt')} END AS a_alt FROM sa),""" + elements_ctes(
        "sb", ("a_href",)) + f""",
st1 AS (SELECT *, {best} AS best FROM elements),
st2 AS (SELECT *, best.p AS main_pos, best.e AS main_end,
  best.g AS main_tag, -best.nl AS main_len FROM st1),
st3 AS (SELECT *,
  CASE WHEN m_noise AND main_pos IS NOT NULL AND pos >= main_pos THEN end_pos END AS m_end,
  CASE WHEN p_noise THEN end_pos END AS p_end
  FROM st2),
st4 AS (SELECT *,
  coalesce(max(m_end) OVER {w_run} > pos, false) AS in_main_noise,
  coalesce(max(p_end) OVER {w_run} > pos, false) AS in_page_noise
  FROM st3),
structure AS (SELECT *,
  CASE WHEN main_pos IS NOT NULL THEN pos >= main_pos AND pos < main_end AND NOT in_main_noise
       ELSE NOT in_page_noise END AS keep
  FROM st4)"""


def title_text_sql() -> str:
    return trim_ws_sql("(CASE WHEN kind = 'raw' THEN text WHEN next_kind = 'text' THEN next_text ELSE '' END)")


def title_agg_sql(whole_page: bool = False) -> str:
    cand = "tag = 'title' AND kind IN ('raw', 'start')"
    if not whole_page:
        cand += " AND (main_pos IS NOT NULL OR NOT in_page_noise)"
    return (f"coalesce(min(CASE WHEN {cand} THEN {{'p': pos, 't': {title_text_sql()}}} END).t, "
            f"{lit(NO_TITLE)})")
