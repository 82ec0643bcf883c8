"""Language ID by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes is learned and then frozen.  A byte
that its context has seen n times costs -log2(n / (N + D)) bits (N: bytes seen there, D: different
ones; escape method C); else it costs the escape, -log2(D / (N + D)), plus its cost in the context
that is one byte shorter, at last 8 bits.  A text's cost in a language is the sum over its whole
UTF-8 bytes, A-Z read as a-z, from a start of ORDER newlines.  The language with the least cost
wins (the first by name on a tie); the score is its share of 2 ** -cost.

Null, empty and letterless texts are `und` with score 0, as is every text if no row could be
learned from.  Repeated rows give repeated results; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_columns, small
from .shingles import in_chunks

ORDER = 3
#: About so many labelled texts of each language are learned from, whole, picked by a hash of the id.
SAMPLE_TEXTS = 2_000
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_STEP = 1 << 20
#: Bytes of text scored at once; the arrays for it take about 150 times that.
PART = 1 << 17


def _grams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte of the texts, as integers; bytes before each text."""
    start = b"\n" * ORDER
    buf = _LOWER[np.frombuffer(start + start.join(data), np.uint8)].astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    key = np.zeros(len(buf) - ORDER, np.uint32)
    for j in range(ORDER + 1):
        key = (key << np.uint32(8)) | buf[j:len(key) + j]
    own = np.arange(at[-1]) + ORDER * np.repeat(np.arange(len(data)), np.diff(at))
    return key[own], at


@dataclass
class Model:
    """languages; for each order k the sorted keys of k + 1 bytes that any language has seen with
    their costs (a column for each language), and the sorted contexts with their escape costs."""

    languages: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each key's last byte after the others, a column for each language."""
        if order < 0:
            return np.full((len(key), len(self.languages)), 8, np.float32)
        low = key & np.uint32((1 << 8 * (order + 1)) - 1)
        at = np.minimum(np.searchsorted(self.keys[order], low), len(self.keys[order]) - 1)
        out = self.costs[order][at]
        new = np.flatnonzero(self.keys[order][at] != low)
        if len(new):
            out[new] = self.escape(low[new] >> np.uint32(8), order) + self.cost(key[new], order - 1)
        return out

    def escape(self, context: np.ndarray, order: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
        return np.where((self.contexts[order][at] == context)[:, None], self.escapes[order][at], np.float32(0))

    def totals(self, data: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        key, at = _grams(data)
        run = np.zeros((len(data), len(self.languages)))
        for a in range(0, len(key), _STEP):
            part = self.cost(key[a:a + _STEP]).astype(np.float64)
            first, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, a + len(part), "left")
            full = np.flatnonzero(np.diff(at[first:last + 1])) + first
            run[full] += np.add.reduceat(part, np.maximum(at[full] - a, 0))
        return run


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of {language: (keys of ORDER + 1 bytes, counts)}."""
    langs = sorted(counts)
    model = Model(langs, [], [], [], [])
    for order in range(ORDER + 1):
        seen = {}
        for x in langs:
            low = counts[x][0] & np.uint32((1 << 8 * (order + 1)) - 1)
            k, at = np.unique(low, return_inverse=True)
            seen[x] = k, np.bincount(at, counts[x][1])
        keys = np.unique(np.concatenate([k for k, _ in seen.values()]))
        ctx = np.unique(keys >> np.uint32(8))
        n, total, kinds = (np.zeros((s, len(langs))) for s in (len(keys), len(ctx), len(ctx)))
        for j, x in enumerate(langs):
            k, c = seen[x]
            n[np.searchsorted(keys, k), j] = c
            np.add.at(total[:, j], np.searchsorted(ctx, k >> np.uint32(8)), c)
            np.add.at(kinds[:, j], np.searchsorted(ctx, k >> np.uint32(8)), 1)
        esc = np.log2(np.where(total > 0, total + kinds, 1) / np.maximum(kinds, 1))
        at = np.searchsorted(ctx, keys >> np.uint32(8))
        if order:  # the frozen shorter contexts give what a language escapes to
            down = model.cost(keys, order - 1)
        else:
            down = np.full((len(keys), len(langs)), 8.0)
        cost = np.where(n > 0, np.log2(np.maximum(total[at] + kinds[at], 1) / np.maximum(n, 1)), esc[at] + down)
        model.keys.append(keys)
        model.costs.append(cost.astype(np.float32))
        model.contexts.append(ctx)
        model.escapes.append(esc.astype(np.float32))
    return model


def learn(docs: DataFrame, sample: int = SAMPLE_TEXTS) -> Model | None:
    """Model of the rows (doc_id, text, lang) with a text and a language: about `sample` whole texts
    of each language, or all if it has no more."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), sample / F.col("count")).alias("share"))
    picked = (rows.join(small(share), "lang")
              .where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) < F.col("share") * (1 << 30)))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for lang in sorted(set(b["lang"])):
                for _, data in in_chunks([t for t, x in zip(b["text"], b["lang"], strict=True) if x == lang]):
                    k, c = np.unique(_grams(data)[0], return_counts=True)
                    yield {"lang": [lang] * len(k), "gram": k.astype(np.int64), "n": c}

    # as large as the sample at most, whatever the corpus
    got = (map_columns(picked.select("text", "lang"), count, "lang string, gram long, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if got.empty:
        return None
    return build({x: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for x, g in got.groupby("lang")})


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _identified(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
    known = [model is not None and has_letter(t) for t in texts]
    lang, score, bits = [UNKNOWN] * len(known), [0.0] * len(known), [None] * len(known)
    at = [i for i, ok in enumerate(known) if ok]
    for first, data in in_chunks([texts[i] for i in at], PART):
        total = model.totals(data)
        best, least = total.argmin(axis=1), total.min(axis=1)
        share = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
        for j, i in enumerate(at[first:first + len(data)]):
            lang[i], score[i], bits[i] = model.languages[best[j]], float(share[j]), float(least[j] / len(data[j]))
    return lang, score, bits


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, bits) for each row of docs (doc_id, text); bits: the least
    cost of a byte on average, null for `und`."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            lang, score, bits = _identified(model, b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": lang, "score": score, "bits": bits}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each,
                       "doc_id long, lang_pred string, score double, bits double")


def identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language of score `least` or more; columns as they are."""

    def sure(texts: pd.Series) -> pd.Series:
        lang, score, _ = _identified(model, [t if isinstance(t, str) else None for t in texts])
        give_back()
        return pd.Series([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], dtype=bool)

    return docs.where(F.pandas_udf(sure, "boolean")(F.col("text")))
