"""Text scalars: whitespace, entities, truncation, escaping.

Each function has a Spark form (``Column -> Column``) and an ``*_sql`` form
that writes the same computation as DuckDB SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import C1_TEXT, ENTITIES, LEGACY_ENTITIES, LEGACY_RE, REFERENCE_RE, TRUNCATION_MARKER, WS, WS_CHARS
from .sqltext import lit

_TRIM_RE = f"^{WS}+|{WS}+$"


def trim_ws(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (Python ``str.strip``).

    ``btrim`` with an explicit character set: no regex per row.
    """
    return F.btrim(c, F.lit(WS_CHARS))


def trim_ws_sql(e: str) -> str:
    return f"regexp_replace({e}, {lit(_TRIM_RE)}, '', 'g')"


def collapse_ws(c: Column) -> Column:
    """Every whitespace run becomes one space (HTML rendering of text)."""
    return F.regexp_replace(c, f"{WS}+", " ")


def collapse_ws_sql(e: str) -> str:
    return f"regexp_replace({e}, {lit(WS + '+')}, ' ', 'g')"


def _table(names: dict[str, str]) -> Column:
    """A constant map, written as two strings so that a plan holds it as one folded literal."""
    split = lambda words: F.split(F.lit("\u0001".join(words)), "\u0001", -1)
    return F.map_from_arrays(split(names), split(names.values()))


def _referred(ref: Column, attribute: bool) -> Column:
    """What a match of ``REFERENCE_RE`` stands for: U+FFFD for a number that is none, the reference
    itself for an unknown name."""
    body = F.regexp_replace(ref, "^&|;$", "")
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 9)).try_cast("long")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    char = F.when(number.between(128, 159), F.substring(F.lit(C1_TEXT), (number - 127).cast("int"), F.lit(1))).otherwise(char)
    # a lookup walks its map: the short one, with nearly all that pages write, comes first
    named = F.when(ref.endswith(";"), F.coalesce(_table(LEGACY_ENTITIES)[body], _table(ENTITIES)[body]))
    if attribute:
        legacy = _table(LEGACY_ENTITIES)[body]
    else:
        name = F.regexp_extract(body, LEGACY_RE, 0)
        legacy = F.concat(_table(LEGACY_ENTITIES)[name], F.substring(ref, F.length(name) + 2, F.length(ref)))
    return F.when(body.startswith("#"), char).otherwise(F.coalesce(named, legacy, ref))


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Decode the character references of HTML 5; strings without ``&`` (most text) are left at once.

    A legacy name needs no ``;``: in text the longest one that begins the word counts (``&notit;``
    is ``¬it;``), in an ``attribute`` only a whole word with no ``=`` behind it, so that
    ``?a=1&copy=2`` stays.  Spark has no callback replace, so the text is split around the
    references, each is looked up, and both are zipped back together.
    """
    gaps, refs = F.split(c, REFERENCE_RE, -1), F.regexp_extract_all(c, F.lit(REFERENCE_RE), 0)
    pieces = F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.when(r.isNull(), "").otherwise(_referred(r, attribute))))
    return F.when(F.instr(c, "&") > 0, F.array_join(pieces, "")).otherwise(c)


def _table_sql(names: dict[str, str]) -> str:
    split = lambda words: f"string_split({lit(chr(1).join(words))}, chr(1))"
    return f"map({split(names)}, {split(names.values())})"


def decode_entities_sql(e: str, attribute: bool = False) -> str:
    body = "regexp_replace(r, '^&|;$', '', 'g')"
    number = (f"CASE WHEN regexp_matches({body}, '^#[xX]') THEN try_cast('0x' || substr({body}, 3) AS BIGINT) "
              f"ELSE try_cast(substr({body}, 2) AS BIGINT) END")
    char = (f"CASE WHEN ({number}) BETWEEN 128 AND 159 THEN substr({lit(C1_TEXT)}, ({number}) - 127, 1) ELSE "
            f"chr(CASE WHEN ({number}) BETWEEN 1 AND 1114111 AND NOT ({number}) BETWEEN 55296 AND 57343 "
            f"THEN ({number})::INTEGER ELSE 65533 END) END")
    named = f"CASE WHEN ends_with(r, ';') THEN {_table_sql(ENTITIES)}[{body}] END"
    if attribute:
        legacy = f"{_table_sql(LEGACY_ENTITIES)}[{body}]"
    else:
        name = f"regexp_extract({body}, {lit(LEGACY_RE)}, 0)"
        legacy = f"{_table_sql(LEGACY_ENTITIES)}[{name}] || substr(r, length({name}) + 2)"
    one = f"CASE WHEN starts_with({body}, '#') THEN {char} ELSE coalesce({named}, {legacy}, r) END"
    refs = f"list_transform(regexp_extract_all({e}, {lit(REFERENCE_RE)}, 0), lambda r: {one})"
    gaps = f"regexp_split_to_array({e}, {lit(REFERENCE_RE)})"
    return (f"(CASE WHEN contains({e}, '&') THEN array_to_string(list_transform(list_zip({gaps}, {refs}), "
            f"lambda z: z[1] || coalesce(z[2], '')), '') ELSE {e} END)")


def truncate(c: Column, max_chars) -> Column:
    """Cut to ``max_chars`` and append the marker when longer.

    Python slice semantics: a negative limit drops that many characters from
    the end (and, being below any length, always adds the marker).  A NULL
    limit leaves the text as it is.
    """
    n = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    keep = F.when(n >= 0, n).otherwise(F.greatest(F.length(c) + n, F.lit(0)))
    cut = F.concat(F.substring(c, F.lit(1), keep), F.lit(TRUNCATION_MARKER))
    return F.when(n.isNull(), c).when(F.length(c) > n, cut).otherwise(c)


def truncate_sql(e: str, n: str) -> str:
    keep = f"(CASE WHEN {n} >= 0 THEN {n} ELSE greatest(length({e}) + {n}, 0) END)"
    return (f"(CASE WHEN {n} IS NULL THEN {e} WHEN length({e}) > {n} "
            f"THEN substr({e}, 1, {keep}) || {lit(TRUNCATION_MARKER)} ELSE {e} END)")


def escape_markup(c: Column) -> Column:
    """Backslash-escape ``[``, ``]`` and ``!`` for display in notices."""
    return F.regexp_replace(c, r"([\[\]!])", r"\\$1")


def escape_markup_sql(e: str) -> str:
    return f"regexp_replace({e}, '([\\[\\]!])', '\\\\\\1', 'g')"
