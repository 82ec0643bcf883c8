"""Model output chunks.

``chunks(key..., seq, chunk)``: ordered pieces of one response.  Lines are
built without first concatenating a whole response: every chunk is cut into
pieces at newlines, a piece's line number is the count of line ends before it
(a prefix sum), and each line is the ordered concatenation of its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import ordered_join
from ..functions.patterns import SNAPSHOT_EVERY
from .sequence import prefix_sum

LINE_PIECE_RE = r"[^\n]*\n|[^\n]+"


def drop_empty(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """NULL and empty chunks carry nothing and are skipped."""
    return chunks.where(F.col(chunk).isNotNull() & (F.col(chunk) != ""))


def response_lines(chunks: DataFrame, keys: list[str], seq: str = "seq", chunk: str = "chunk",
                   seq_bucket: int = 4096) -> DataFrame:
    """K2: whole lines (each keeps its ``\\n``) and the unterminated remainder last.

    Output ``keys..., line_no, line`` (``line_no`` 0-based).
    """
    p = drop_empty(chunks, chunk).select(
        *keys, seq, F.posexplode(F.regexp_extract_all(F.col(chunk), F.lit(LINE_PIECE_RE), 0))
        .alias("piece_idx", "piece"))
    p = (p.withColumn("_ends", F.col("piece").endswith("\n").cast("long"))
         .withColumn("_b", F.floor(F.col(seq) / seq_bucket).cast("long")))
    p = prefix_sum(p, keys, "_b", [seq, "piece_idx"], "_ends", "line_no", inclusive=False)
    return (p.groupBy(*keys, "line_no")
            .agg(ordered_join("piece", [seq, "piece_idx"]).alias("line")))


def snapshot_offsets(lines: DataFrame, keys: list[str], every: int = SNAPSHOT_EVERY, line_bucket: int = 4096) -> DataFrame:
    """H3 as offsets: after every ``every``-th line, and after the last one, where the text shown ends.

    Output ``keys..., n_lines, end``: the first ``n_lines`` lines are the first ``end`` characters of
    the response.  Lengths are summed in buckets of lines, so a long response is cut into many tasks,
    and what is stored of a response grows with its lines, not with their square.  NULL keys are a
    response of their own; no lines, no rows.
    """
    x = lines.select(*keys, "line_no", F.length("line").cast("long").alias("_len"),
                     F.floor(F.col("line_no") / line_bucket).cast("long").alias("_b"))
    x = prefix_sum(x, keys, "_b", ["line_no"], "_len", "end", inclusive=True)
    n = F.col("line_no") + 1
    due = x.where(n % every == 0).select(*keys, n.alias("n_lines"), "end")
    last = x.groupBy(*keys).agg(F.max(F.struct(n.alias("n_lines"), "end")).alias("_last"))
    return due.unionByName(last.where(F.col("_last.n_lines") % every != 0).select(*keys, "_last.*"))


def snapshot_texts(offsets: DataFrame, responses: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """The stored response cut at each offset: ``keys..., n_lines, content``.

    The response moves once to its offsets' key; each text is cut when it is read."""
    on = None
    r = responses.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(response).alias("_response"))
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return offsets.join(r, on).select(*keys, "n_lines", F.substring("_response", F.lit(1), F.col("end").cast("int")).alias("content"))


def full_text(chunks: DataFrame, keys: list[str], seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """``keys..., response``: the chunks of a response in order as one text."""
    return drop_empty(chunks, chunk).groupBy(*keys).agg(ordered_join(chunk, [seq]).alias("response"))


def snapshots(chunks: DataFrame, keys: list[str], every: int = SNAPSHOT_EVERY) -> DataFrame:
    """H3: the text shown after every ``every``-th line, and after the last one: ``keys..., n_lines, content``."""
    return snapshot_texts(snapshot_offsets(response_lines(chunks, keys), keys, every), full_text(chunks, keys), keys)
