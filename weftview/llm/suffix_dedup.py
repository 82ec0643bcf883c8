"""Suffix-array removal of byte strings that repeat across a corpus.

Every byte that a WIDTH-byte string covers which also starts elsewhere goes, judged on the input.

1. *Cut.*  A window of WIDTH bytes is anchored at its least GRAM-byte hash (the leftmost of equal
   ones): equal windows have equal anchors at equal places.  Consecutive windows with one anchor,
   at a distance to it within one step of STEP, form a piece.  All of them hold the same core
   of WIDTH - STEP + 1 bytes, so that equal windows lie in pieces with equal keys (core and
   step).  A piece is a row of hashes and places: the text stays where it is.
2. *Group.*  A key that one piece has repeats nothing: keys alone are counted first, and only the
   pieces of shared keys move.  Pieces that are equal as wholes repeat in all their windows.  What is left to decide
   are pieces that are alone but share their key.  Only these, and one of each set of equal pieces
   with such a key, send their bytes.
3. *Order.*  The pieces of a key are joined to one string, the core as one symbol and a separator
   of its own behind each, and its suffixes put in order (suffix_order).  Suffixes that share the
   symbols of a window stand side by side: a window repeats if the next or the previous one has
   the same symbols.
4. *Remove.*  Each document's spans are merged and cut out of its bytes.

A key of over HOT pieces is cut again into windows at most RECUT apart, each a unit of work.  Keys
that still have over HOT pieces are cut into single windows, counted by a hash of 16 bytes with
partial counts: no task holds more than HOT pieces of a key.

Null texts are empty; texts under WIDTH bytes hold no window.  Repeated rows repeat each other and
lose every byte that a window covers.  Rows without a doc_id take part like any other.  Extra
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, saved, small
from .shingles import _powers as powers
from .shingles import mix
from .suffix_order import suffix_order

WIDTH = 200
GRAM = 16
STEP = 64
HOT = 5_000
RECUT = 8
_CHUNK = 1 << 22
_POS = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(404).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` consecutive ones."""
    n = len(a)
    x = np.full(-(-n // width) * width + width, np.uint64(2**64 - 1))
    x[:n] = a
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def pieces(data: bytes, width: int = WIDTH, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, whole, start, length, core) of the text's pieces: hashes of core and step, and of the
    bytes; first byte, length and where in the piece the core begins.  A chunk at a time."""
    for base in range(0, max(1, len(data) - width + 1), _CHUNK):
        x = np.frombuffer(data, np.uint8)[base:base + _CHUNK + width - 1]
        n = len(x)
        if n < width:
            return
        up, down = powers(n + 1)
        run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[x] * up[:n], dtype=np.uint64)])
        hashed = lambda a, b: mix((run[b] - run[a]) * down[a])  # noqa: B023, E731
        first = np.arange(n - GRAM + 1)
        rank = (hashed(first, first + GRAM) & ~_POS) | first.astype(np.uint64)
        anchor = (_least(rank, width - GRAM + 1) & _POS).astype(np.int64)
        ahead = (anchor - np.arange(len(anchor))) // step
        mark = anchor * (width // step + 1) + ahead
        start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        end = np.append(start[1:], len(mark)) - 1 + width
        part, at = ahead[start].astype(np.uint64), anchor[start]
        core = at - step * ahead[start]
        key = hashed(core, core + width - step + 1) ^ mix(part + np.uint64(77))
        whole = hashed(start, end) ^ mix((at - start).astype(np.uint64) * np.uint64(3) + np.uint64(5))
        yield key.view(np.int64), whole.view(np.int64), start + base, end - start, core - start


def _identity() -> Column:
    """Names a row by its id and text, alike in every scan."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _cut(width: int, step: int):
    """Pieces as rows; place: start, length and core in one number."""
    if width + step > 4096:
        raise ValueError("width and step are over 4096 bytes together")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("key", "whole", "place")
        for b in batches:
            rows, out, size = [], [], 0
            for row, text in zip(b["row"], b["text"], strict=True):
                for key, whole, start, length, core in pieces(_encoded(text), width, step):
                    p = key, whole, start << 24 | length << 12 | core
                    rows.append(np.full(len(p[0]), row, np.int64))
                    out.append(p)
                    size += len(p[0])
                    if size > 1 << 17:
                        yield {"row": np.concatenate(rows), **{c: np.concatenate(v) for c, v in zip(names, zip(*out), strict=True)}}
                        rows, out, size = [], [], 0
            if size:
                yield {"row": np.concatenate(rows), **{c: np.concatenate(v) for c, v in zip(names, zip(*out), strict=True)}}

    return each


def repeated_windows(parts: list[bytes], cores: list[int], core: int, width: int = WIDTH) -> list[list[int]]:
    """For each piece the windows (by first byte) that another piece or window repeats.

    `parts` share the `core` bytes that begin at cores[i], and all their windows hold them."""
    size = width - core + 1  # symbols of a window
    texts, start, at = [], [], 0
    for i, (p, c) in enumerate(zip(parts, cores, strict=True)):
        texts.append(p[:c].decode("latin-1") + chr(0x100) + p[c + core:].decode("latin-1") + chr(0x10000 + i))
        start.append(at)
        at += len(texts[-1])
    s = "".join(texts)
    order = suffix_order(s)
    seen = bytearray(len(s))
    last, before = "", -1
    for i in order:
        now = s[i:i + size]
        if now == last and len(now) == size:
            seen[i] = seen[before] = 1
        last, before = now, i
    return [[b for b in range(len(p) - width + 1) if seen[a + b]] for p, a in zip(parts, start, strict=True)]


def _spans(windows: list[int], base: int, width: int) -> Iterator[tuple[int, int]]:
    a = None
    for w in windows:
        if a is None:
            a = b = w
        elif w > b + 1:
            yield base + a, base + b + width
            a = w
        b = w
    if a is not None:
        yield base + a, base + b + width


def _ordered(width: int, core: int, hot: int):
    """Rows sorted by key, a key's rows (of `hot` pieces at most) together: spans of the pieces that are alone."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[bytes, list] = {}
        key = None

        def done() -> Iterator[dict]:
            out = {"row": [], "start": [], "end": []}
            parts = list(held)
            if len(parts) > 1:
                found = repeated_windows([p[1] for p in parts], [p[0] for p in parts], core, width)
            else:
                found = [[] for _ in parts]
            for p, windows in zip(parts, found, strict=True):
                rows = held[p]
                if len({(r, s) for r, s, _ in rows}) > 1:  # after a second cut equal pieces may meet here
                    windows = range(len(p[1]) - width + 1)
                for row, start, n in rows:
                    if n == 1:
                        for a, b in _spans(windows, start, width):
                            out["row"].append(row)
                            out["start"].append(a)
                            out["end"].append(b)
            if out["row"]:
                yield out

        for b in batches:
            for k, row, start, at, n, data in zip(b["key"], b["row"], b["start"], b["core"], b["n"], b["bytes"], strict=True):
                if k != key:
                    yield from done()
                    held, key = {}, k
                held.setdefault((at, data), []).append((row, start, n))
                if len(held) > hot:
                    raise ValueError(f"a key has more than {hot} pieces")
        yield from done()

    return each


def _fetched(width: int):
    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for row, text, wanted in zip(b["row"], b["text"], b["wanted"], strict=True):
                data = _encoded(text)
                at = [(w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095) for w in wanted]
                yield {"key": [w["key"] for w in wanted], "row": [row] * len(wanted), "start": [a for a, _, _ in at], "core": [c for _, _, c in at],
                       "n": [w["n"] for w in wanted], "bytes": [data[a:a + n] for a, n, _ in at]}

    return each


def _recut(width: int, step: int, fine: int):
    """Pieces of keys with many pieces, cut again so that windows are less than `fine` apart."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"key": [], "row": [], "start": [], "core": [], "n": [], "bytes": []}
            for k, row, start, core, n, data in zip(b["key"], b["row"], b["start"], b["core"], b["n"], b["bytes"], strict=True):
                # window w begins core - w bytes before the core; cut at multiples of `fine` of that distance
                w, last = 0, len(data) - width
                while w <= last:
                    at = core - (core - w) // fine * fine  # the part's last possible window, where its core begins
                    end = min(last, at)
                    mid = data[at:at + width - fine + 1]
                    digest = hashlib.blake2b(b"%d:%d:" % (k, core - at) + mid, digest_size=8).digest()
                    out["key"].append(int.from_bytes(digest, "little", signed=True))
                    out["row"].append(row)
                    out["start"].append(start + w)
                    out["core"].append(at - w)
                    out["n"].append(n)
                    out["bytes"].append(data[w:end + width])
                    w = end + 1
            yield out

    return each


def _windows(width: int):
    """Each window of the pieces by a hash of its bytes."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"digest": [], "row": [], "start": [], "n": []}
            for row, start, n, data in zip(b["row"], b["start"], b["n"], b["bytes"], strict=True):
                for w in range(len(data) - width + 1):
                    out["digest"].append(hashlib.blake2b(data[w:w + width], digest_size=16).digest())
                    out["row"].append(row)
                    out["start"].append(start + w)
                    out["n"].append(n)
            yield out

    return each


def repeated_spans(docs: DataFrame, width: int = WIDTH, step: int = STEP, hot: int = HOT, fine: int = RECUT) -> DataFrame:
    """Rows (row, start, end): byte spans that repeated windows cover, by the row's identity."""
    docs = docs.select(_identity().alias("row"), "text")
    cut = saved(map_columns(docs, _cut(width, step), "row long, key long, whole long, place long"))
    shared = cut.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = saved(cut.join(shared, "key", "left_semi"))
    kinds = rows.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"))
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    kept = saved(kinds.join(keys, "key").select("key", "whole", "n", "one", F.expr("kinds > 1 and least = 1").alias("open"), "kinds"))

    alike = kept.where("n > 1").select("key", "whole")
    spans = rows.join(alike, ["key", "whole"]).select("row", F.shiftright("place", 24).alias("start"), F.shiftright("place", 12).bitwiseAND(4095).alias("length"))
    spans = spans.select("row", "start", (F.col("start") + F.col("length")).alias("end"))

    wanted = kept.where("open").select(F.col("one.row").alias("row"), F.struct("key", "one.place", "n").alias("w"))
    wanted = saved(wanted.groupBy("row").agg(F.collect_list("w").alias("wanted")))  # at most a document's own pieces
    texts = docs.join(small(wanted.select("row")), "row", "left_semi").join(wanted, "row").dropDuplicates(["row"])
    piece = "key long, row long, start long, core int, n long, bytes binary"
    data = saved(map_columns(texts, _fetched(width), piece))
    many = small(saved(kept.where("open").where(F.col("kinds") > hot).select("key").distinct()))
    again = map_columns(data.join(many, "key", "left_semi"), _recut(width, step, fine), piece)
    most = small(saved(again.groupBy("key").count().where(F.col("count") > hot).select("key")))
    single = saved(map_columns(again.join(most, "key", "left_semi"), _windows(width), "digest binary, row long, start long, n long"))
    twice = single.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    lone = single.where("n = 1").join(twice, "digest").select("row", "start", (F.col("start") + width).alias("end"))
    run = lambda d, core: map_columns(d.repartition("key").sortWithinPartitions("key"), _ordered(width, core, hot), "row long, start long, end long")
    return (spans.unionByName(run(data.join(many, "key", "left_anti"), width - step + 1))
            .unionByName(run(again.join(most, "key", "left_anti"), width - fine + 1)).unionByName(lone))


def _removed(batches: Iterator[dict]) -> Iterator[dict]:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for b in batches:
        out = []
        for doc, text, spans in zip(b["doc_id"], b["text"], b["spans"], strict=True):
            data = _encoded(text)
            keep, at, removed, runs = [], 0, 0, 0
            for s in sorted(spans or ()):
                a, e = s >> 32, s & 0xFFFFFFFF
                if not runs or a > at:  # spans that touch make one run
                    keep.append(data[at:a])
                    at, runs = a, runs + 1
                if e > at:
                    removed += e - at
                    at = e
            keep.append(data[at:])
            out.append((doc, len(data), removed, runs, hashlib.sha256(b"".join(keep)).hexdigest()))
        if out:
            yield dict(zip(names, zip(*out), strict=True))


def without_repeats(docs: DataFrame, width: int = WIDTH, step: int = STEP, hot: int = HOT, fine: int = RECUT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one per row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, width, step, hot, fine).select("row", (F.col("start") * (1 << 32) + F.col("end")).alias("s"))
    spans = spans.groupBy("row").agg(F.collect_list("s").alias("spans"))
    return map_columns(docs.withColumn("row", _identity()).join(spans, "row", "left").select("doc_id", "text", "spans"), _removed,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
