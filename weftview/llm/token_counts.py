"""Token counts of documents in flat token files without an index.

A flat token file is a run of unsigned 16-bit ids in which an end id closes each document; nothing
says where documents begin.  Files are held as blocks of equal length, so that one file is read by
many tasks.  The scan finds the end ids of a block with one vectorised comparison and sends only
their places.  Documents cross blocks: a prefix scan over the blocks of a file (sums of tokens and
documents, and the last end before each block) gives every end its place in the file and its
document's first token.  The scan is done in two levels, within stretches of blocks and over the
stretches, so that one huge file isn't one task's.

Tokens behind a file's last end id are no document.  Null and empty texts are an end id alone and
count 0 tokens.  Empty files and blocks add nothing.  Repeated rows count as often as they come.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, saved

END_ID = 50256
BLOCK = 1 << 18
STRETCH = 256


def token_files(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Flat token files of docs (doc_id, text), one a task: rows (file, block, ids, doc_ids).

    ids: up to `block` little-endian unsigned 16-bit ids; doc_ids: names of the documents that
    end in the block, in order - a label list without any place or length."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        ids_of, file, number = encode(), TaskContext.get().partitionId(), 0
        buf, size, names = [], 0, []

        def full() -> Iterator[dict]:
            nonlocal buf, size, number, names
            flat = np.concatenate(buf)
            while len(flat) >= block:
                ends = int((flat[:block] == end_id).sum())
                yield {"file": [file], "block": [number], "ids": [flat[:block].tobytes()], "doc_ids": [names[:ends]]}
                flat, names, number = flat[block:], names[ends:], number + 1
            buf, size = [flat], len(flat)

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*(ids_of(text) if text else ()), end_id], "<u2")
                buf.append(ids)
                names.append(doc)
                size += len(ids)
                if size >= block:
                    yield from full()
        if size:
            flat = np.concatenate(buf)
            yield {"file": [file], "block": [number], "ids": [flat.tobytes()], "doc_ids": [names]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "file long, block long, ids binary, doc_ids array<long>")


def separator_scan(blocks: DataFrame, end_id: int = END_ID, stretch: int = STRETCH) -> DataFrame:
    """Rows (file, ordinal, doc_id, first_token, n_tokens): every document of blocks (file, block,
    ids, doc_ids), n_tokens without the end id."""

    def ends(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u2") for x in b["ids"]]
            yield {"file": b["file"], "block": b["block"], "n": [len(x) for x in ids], "doc_ids": b["doc_ids"],
                   "ends": [np.flatnonzero(x == end_id) for x in ids]}

    found = saved(map_columns(blocks.select("file", "block", "ids", "doc_ids"), ends,
                              "file long, block long, n long, doc_ids array<long>, ends array<long>"))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    part = found.select("file", "block", F.floor(F.col("block") / stretch).alias("run"), "n", F.size("ends").cast("long").alias("docs"), last.alias("last"))
    # within a stretch, then over the stretches of a file; `last` counts from the stretch's or file's start
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    part = part.select("file", "block", "run", "n", "docs", "base", (F.col("base") + F.col("last")).alias("last"),
                       F.coalesce(F.sum("docs").over(inner), F.lit(0)).alias("before"))
    part = part.withColumn("prior", F.max("last").over(inner))
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = part.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max("last").alias("last"))
    runs = runs.withColumn("run_base", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    runs = runs.select("file", "run", "run_base", F.coalesce(F.sum("docs").over(outer), F.lit(0)).alias("run_docs"),
                       F.coalesce(F.max(F.col("run_base") + F.col("last")).over(outer), F.lit(-1)).alias("run_prior"))
    carry = part.join(runs, ["file", "run"]).select(
        "file", "block", (F.col("run_base") + F.col("base")).alias("base"), (F.col("run_docs") + F.col("before")).alias("docs"),
        F.coalesce(F.col("run_base") + F.col("prior"), F.col("run_prior")).alias("prior"))
    done = found.where(F.size("ends") > 0).join(carry, ["file", "block"])
    each = done.select("file", "base", "docs", "prior", "ends", F.posexplode(F.arrays_zip("ends", "doc_ids")).alias("i", "e"))
    start = F.when(F.col("i") == 0, F.col("prior")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1)) + 1
    return (each.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), F.col("e.doc_ids").alias("doc_id"), start.alias("first_token"),
                        (F.col("base") + F.col("e.ends")).alias("end"))
            .select("file", "ordinal", "doc_id", "first_token", (F.col("end") - F.col("first_token")).alias("n_tokens")))


_loaded: dict = {}


def _ranked(path: str, pattern: str) -> Callable[[str], list[int]]:
    """One encoder per worker process, which Spark uses for many tasks."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, pattern: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, n_tokens, file, ordinal, first_token) of docs: token files are written to the
    shared folder, then scanned."""
    files = saved(token_files(docs, lambda: _ranked(path, pattern), end_id, block))
    return separator_scan(files, end_id).select("doc_id", "n_tokens", "file", "ordinal", "first_token")
