"""Stored HTTP responses -> page HTML (A1-A3).

``responses(url, status, charset, body BINARY)``: an error status (>= 400) or a
missing body is a failed load.  The declared charset is kept unless it is
missing, ASCII or ISO-8859-1 (values servers often send by default); then the
bytes are checked: valid UTF-8 is read as UTF-8, and for anything else the charset
is detected (``charsets``).  A declared UTF-8 body with bad sequences gets U+FFFD
replacements.  Any other declared charset is decoded by Python's codecs, bad
sequences replaced; one that no codec knows counts as not declared.

UTF-8 bodies are decoded in the JVM.  The rest, few rows of a crawl, go to Python
in pickled batches of a hundred rows, as an Arrow batch of 10,000 whole bodies would all be
in a worker's memory at once; other rows send nulls there, not their bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charsets import detected_text

# --- fixed values: charsets treated as "not really declared" -------------------
SUSPECT_CHARSETS = ("", "ISO-8859-1", "LATIN-1", "LATIN1", "ASCII", "US-ASCII")
UTF8_NAMES = ("UTF-8", "UTF8")


def _charset(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def _by_codec(body: bytes | None, charset: str | None) -> str | None:
    """The body read by the named codec, else by the detected one."""
    if body is None:
        return None
    try:
        return bytes(body).decode(charset, "replace") if charset else detected_text(bytes(body))
    except (LookupError, ValueError):  # not a charset's name
        return detected_text(bytes(body))


def decode_body(body: Column, charset: Column) -> Column:
    """A2: the body as text; NULL for no body."""
    cs = _charset(charset)
    as_text = body.cast("string")
    suspect, declared_utf8 = cs.isin(*SUSPECT_CHARSETS), cs.isin(*UTF8_NAMES)
    python = ~declared_utf8 & ~(suspect & F.is_valid_utf8(as_text))
    decoded = F.udf(_by_codec, "string", useArrow=False)(F.when(python, body), F.when(python & ~suspect, cs))
    return (F.when(body.isNull(), F.lit(None).cast("string"))
            .when(declared_utf8, F.make_valid_utf8(as_text))
            .when(python, decoded).otherwise(as_text))


def load_pages(responses: DataFrame) -> DataFrame:
    """A1/A3: add ``html`` (NULL on failure), ``ok`` and ``reason``/``message`` for rejects."""
    html = decode_body(F.col("body"), F.col("charset"))
    reason = (F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
              .when(F.col("body").isNull(), F.lit("no response"))
              .when(html == "", F.lit("empty page")))
    out = responses.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return (out.withColumn("html", F.when(ok, html))
            .withColumn("ok", ok)
            .withColumn("message", F.when(~ok, F.concat(F.lit("Failed to load "),
                                                       F.coalesce("url", F.lit(""))))))
