"""Secret scans with multipart credential linking.

Base spans stand on their own: `assign` (a named secret and its value), `access` (access key
identifiers) and `hex` (long lower-case hexadecimal runs).  Other parts of a credential are weak:
`login` (a named user or account), `loose` (a value under a vague name, or a mixed token of high
variety) and `endpoint` (URL, IPv4 address or host with a port).  Weak parts are reported only
together: parts are rows (document, scope, start, end), a scope is a run of lines without a blank
one, and an interval join within the scope keeps a weak part if a part of a complementary role
lies at most REACH characters away: a secret for an identifier or endpoint, an identifier or
endpoint for a secret.  A weak part never overlaps a base span.

Null text counts as empty.  Rows without a doc_id are returned with their base spans only.
Repeated rows give repeated results; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, saved, small

REACH = 400

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is shorter fails whole
ASSIGN_MIN, ACCESS_MIN = 12, 18

LOGIN = re.compile(r"""\b(user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.I | re.A)
LOOSE = re.compile(r"""\b(pwd|pass|auth|key|credentials?|bearer)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_])(?=[A-Za-z+/_]*[0-9])[A-Za-z0-9+/_]{20,}", re.A)
# An endpoint is found from its middle: what stands before `://` or `:port` is a run of characters read once.
URL = re.compile(r"""://[^\s"'<>]+\b""", re.A)
PORT = re.compile(r":\d{2,5}\b", re.A)
ADDRESS = re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", re.A)
HOST_CHARS = string.ascii_letters + string.digits + ".-"
SCHEME = re.compile(r"\b[a-z]", re.I | re.A)
WORD_START = re.compile(r"\b[a-z0-9-]", re.I | re.A)
BLANK = re.compile(r"\n[^\S\n]*\n")

ORDER = {"assign": 0, "access": 1, "hex": 2, "login": 3, "loose": 4, "endpoint": 5}
ROLE = {"assign": "secret", "hex": "secret", "loose": "secret", "access": "identifier", "login": "identifier", "endpoint": "endpoint"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, by start and then kind."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _before(text: str, chars: str, low: int, end: int) -> int:
    """Where the run of `chars` begins that ends at `end`, `low` at least."""
    step = 64
    while low < (a := max(low, end - step)) and not text[a:end].rstrip(chars):
        step *= 2
    return a + len(text[a:end].rstrip(chars))


def _host(text: str, low: int, colon: int) -> int | None:
    """Where the host begins that stands before a colon, in the run from `low`: the first word of two or more."""
    low = max(low, text.rfind("..", low, colon) + 1)
    at = WORD_START.search(text, low + text.startswith(".", low, colon), colon)
    if at and text[colon - 1] != "." and text.find(".", at.start(), colon) > at.start():
        return at.start()
    return None


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, hosts with a port and IPv4 addresses, the first ones where they overlap; at one place in that order."""
    found = [(m.start(), 1, m.end(), 0) for m in ADDRESS.finditer(text)]
    done, at = 0, text.find("://")
    while at >= 0:
        first = SCHEME.search(text, _before(text, HOST_CHARS + "+", done, at), at)
        if m := first and URL.match(text, at):
            found.append((first.start(), 0, m.end(), 0))
            done = m.end()
        at = text.find("://", max(done, at + 3))
    done = 0
    for m in PORT.finditer(text):
        a = _host(text, _before(text, HOST_CHARS, done, m.start()), m.start())
        if a is not None:
            found.append((a, 2, m.end(), m.start()))
        done = m.end()
    heapify(found)
    out: list[tuple[int, int]] = []
    while found:
        a, kind, b, colon = heappop(found)
        end = out[-1][1] if out else 0
        if a >= end:
            out.append((a, b))
        elif kind == 2 and end < colon and (a := _host(text, end, colon)) is not None:
            heappush(found, (a, kind, b, colon))  # what is left of it
    return out


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = [(*m.span(), "login") for m in LOGIN.finditer(text)] + [(*m.span(), "loose") for m in LOOSE.finditer(text)]
    found += [(*m.span(), "loose") for m in MIXED.finditer(text)
              if re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]) and len(set(m[0])) >= 10]
    found += [(*s, "endpoint") for s in endpoints(text)]
    merged: list[list[int]] = []  # base spans may overlap one another
    for a, b, _ in base:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, ends = [m[0] for m in merged], [m[1] for m in merged]

    def free(a: int, b: int) -> bool:
        i = bisect_left(ends, a + 1)
        return i == len(ends) or starts[i] >= b

    return sorted({s for s in found if free(s[0], s[1])})


def _scan(batches: Iterator[dict]) -> Iterator[dict]:
    cols = ("row", "doc_id", "n_assign", "n_access", "n_hex", "base", "parts")
    for b in batches:
        rows = []
        for row, doc, text in zip(b["row"], b["doc_id"], b["text"], strict=True):
            text = text or ""
            base = base_spans(text)
            weak = weak_spans(text, base)
            parts = []
            if weak and len({ROLE[k] for _, _, k in base + weak}) > 1:
                blank = [m.start() for m in BLANK.finditer(text)]
                parts = [f"{k}:{s}:{e}:{bisect_left(blank, s)}" for s, e, k in base + weak]
            rows.append((row, doc, *(sum(x[2] == k for x in base) for k in ("assign", "access", "hex")),
                         ",".join(f"{k}:{s}:{e}" for s, e, k in base), parts))
        yield dict(zip(cols, zip(*rows), strict=True)) if rows else {c: [] for c in cols}


def linked_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak ones of parts (row, scope, kind, start, end) that a complementary part backs."""
    of = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    parts = parts.withColumn("role", of[F.col("kind")])
    weak = parts.where(~F.col("kind").isin("assign", "access", "hex"))
    # a part lies in the bins that it or its reach touches; a weak part is looked for in all of its own
    bins = F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))
    own = F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))
    other = parts.select("row", "scope", F.col("role").alias("role2"), F.col("start").alias("start2"),
                         F.col("end").alias("end2"), F.explode(bins).alias("bin"))
    return (weak.withColumn("bin", F.explode(own)).join(other, ["row", "scope", "bin"])
            .where("(role = 'secret') <> (role2 = 'secret')")
            .where(F.greatest(F.col("start2") - F.col("end"), F.col("start") - F.col("end2")) <= reach)
            .select("row", "kind", "start", "end").distinct())


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per row of docs (doc_id,
    text); spans: kind:start:end of all spans by start and kind, joined by commas."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(map_columns(rows, _scan, "row long, doc_id long, n_assign long, n_access long, n_hex long, base string, parts array<string>"))
    p = F.split("part", ":")
    parts = (found.where(F.size("parts") > 0).select("row", F.explode("parts").alias("part"))
             .select("row", p[3].cast("long").alias("scope"), p[0].alias("kind"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end")))
    more = (linked_weak(parts, reach)
            .groupBy("row").agg(F.array_join(F.collect_set(F.concat_ws(":", "kind", "start", "end")), ",").alias("weak")))
    order = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))
    every = F.split(F.concat_ws(",", F.nullif("base", F.lit("")), "weak"), ",")
    keyed = F.transform(every, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), order[F.split(s, ":")[0]].alias("k"),
                                                  F.split(s, ":")[2].cast("long").alias("b"), s.alias("s")))
    return (found.drop("parts").join(small(saved(more)), "row", "left")
            .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                    F.when(F.col("weak").isNull(), F.col("base"))
                    .otherwise(F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",")).alias("spans")))


def redacted(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """docs with every span of its text replaced by `mark` (overlapping spans by one) and, if there
    is a column n_chars, characters counted anew where the text changed; columns in their order."""
    key, cut = "secret_spans_of", "secret_spans_at"
    while {key, cut} & {c.lower() for c in docs.columns}:
        key, cut = key + "_", cut + "_"
    named = F.xxhash64("doc_id", "text")  # the row by id and text: ids may be null or stand for several texts
    spans = (secret_spans(docs.select(named.alias("doc_id"), "text"), reach).where("spans <> ''")
             .groupBy(F.col("doc_id").alias(key)).agg(F.max("spans").alias(cut)))
    joined = docs.join(small(saved(spans), 100_000), named == F.col(key), "left")
    marked = F.udf(lambda text, at: _cut(text, at, mark), "string", useArrow=True)(F.when(F.col(cut).isNotNull(), F.col("text")), F.col(cut))
    out = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(marked))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(count))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _cut(text: str | None, spans: str | None, mark: str) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:3])) for s in spans.split(",")):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
