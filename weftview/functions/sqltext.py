"""Helpers for writing the DuckDB oracle side of a scalar function."""


def lit(s: str) -> str:
    """A SQL string literal (standard quoting, backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"


def rx_escape(s: str) -> str:
    """Escape a literal for use inside a regular expression (Java and RE2)."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$|?*+()[]{}\-/" else ch)
    return "".join(out)
