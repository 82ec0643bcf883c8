"""Cost-balanced packing of token sequences.

A document's ids are the tokenizer's with the end id behind them.  A task packs runs of whole
documents of GROUP tokens (the last document of a run is cut, its rest opens the next run; a
task's last run is as long as what is left).  A run of T tokens gets T // width sequences of
`width` tokens and, for the rest, one sequence for each power of two in T % width; as these need
no padding, nothing is padded.  An attention model costs a piece of n tokens n + n * n / width.
Documents are taken by descending length: whole widths fill empty sequences, and each remaining
piece goes to the sequence of least cost that has room for it; where none has, it is cut to fill
the one with the most room.

Null and empty texts are the end id alone.  Equal lengths keep the order of the input; repeated
rows are packed as often as they come; extra columns are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

WIDTH = 4096
GROUP = 1 << 20
END_ID = 2
#: Words whose ids a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 300_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_LETTER = "a-zªµºß-öø-ÿ"
_DIGIT = "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
#: The tokenizer's own split, for lower-case text of these characters.
_WORD = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


class WordIds:
    """ids of whole texts by a word-level BPE tokenizer; a word's ids are kept once found.

    The split into words is done here only for plain Latin text, whose lower case and classes are
    certain; any other text, or one with a special token's string, goes to the tokenizer whole.  Words
    found here are lower-case and composed already, so that theirs needs no normalizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.whole = cache(lambda: Tokenizer.from_file(path))  # once a text needs it
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        vocabulary = self.words.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [t is not None and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        words = [_WORD.findall(t.lower()) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = list(set().union(*words).difference(self.kept))
        for a in range(0, len(new), 100):
            self._keep(new[a:a + 100])
        get = self.kept.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), np.uint32) if ok else self._encoded(self.whole(), t) if t else np.zeros(0, np.uint32)
                for t, w, ok in zip(texts, words, plain, strict=True)]

    @staticmethod
    def _encoded(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, words: list[str]) -> None:
        """ids of words, found in one call: the token that ends a word is marked in the vocabulary."""
        ids = self._encoded(self.words, " ".join(words))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words):
            data, a = ids.tobytes(), 0
            for w, b in zip(words, (4 * ends).tolist(), strict=True):
                self.kept[w] = data[a:b]
                a = b
        else:
            self.kept.update((w, self._encoded(self.words, w).tobytes()) for w in words)


def _sizes(total: int, width: int) -> np.ndarray:
    rest = total % width
    return np.array([width] * (total // width) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def pack(lengths: list[int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill all sequences."""
    size = _sizes(sum(lengths), width)
    used, cost = np.zeros_like(size), np.zeros(len(size))
    out, empty = [], 0

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(used[s])))
        used[s] += n
        cost[s] += n + n * n / width

    for doc in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        start, left = 0, lengths[doc]
        while left >= width:
            while empty < len(size) and used[empty]:
                empty += 1
            if empty == len(size) or size[empty] < width:
                break
            put(doc, start, width, empty)
            start, left = start + width, left - width
        while left:
            room = size - used
            fits = np.flatnonzero(room >= left)
            s = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
            n = min(left, int(room[s]))
            put(doc, start, n, s)
            start, left = start + n, left - n
    return out


def _packed(run: list[tuple], first: int, width: int) -> dict:
    """Output columns for a run of (doc_id, ids, start in the document, document's tokens)."""
    rows = []
    for d, start, n, s, offset in pack([len(x[1]) for x in run], width):
        doc, ids, before, total = run[d]
        rows.append((doc, before + start, n, zlib.crc32(ids[start:start + n].tobytes()), total, first + s, offset))
    return dict(zip((f.split()[0] for f in _PIECES.split(", ")), zip(*rows), strict=True))


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all
    rows of docs (doc_id, text).  `tokenizer`: path of the tokenizer's file on every machine."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        ids_of = _worker_ids(tokenizer)
        first, run, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for a in range(0, len(b["text"]), 256):
                for doc, ids in zip(b["doc_id"][a:a + 256], ids_of(b["text"][a:a + 256]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    total, at = len(ids), 0
                    while size + len(ids) - at >= group:
                        run.append((doc, ids[at:at + group - size], at, total))
                        at += group - size
                        yield _packed(run, first, width)
                        first, run, size = first + len(_sizes(group, width)), [], 0
                    if at < total:
                        run.append((doc, ids[at:], at, total))
                        size += total - at
        if run:
            yield _packed(run, first, width)

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, _PIECES)


_loaded: dict[str, WordIds] = {}


def _worker_ids(path: str) -> WordIds:
    """One per worker process, which Spark uses for many tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
