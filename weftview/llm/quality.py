"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read whole, in chunks of CHUNK bytes that overlap by half.  Every STRIDE
bytes a filter bank looks at SPAN bytes: each byte is a learned vector, and channels tell for lags
2 to LAGS + 1 whether a byte equals the one that much earlier (what makes repetition visible to a
linear filter).  Filters are rectified and max-pooled in a chunk, giving its vector; the greatest
and the mean of the chunks' vectors enter one logistic unit.

It is fitted by gradient descent on at most SAMPLE labelled texts, picked by a hash of the id with
equal parts of both labels where there are as many; texts count whole.  Null and empty texts have no chunk and
get the probability of the unit's bias; without labelled rows of both kinds every score is the
share of label 1 (0.5 without any).  Repeated rows give repeated results; extra columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, saved, small

CHUNK, SPAN, STRIDE, LAGS = 256, 12, 4, 22
WIDTH, FILTERS, ECHO = 6, 16, 8
SAMPLE = 2_000
EPOCHS = 6
_BLOCK = 1 << 18


@dataclass
class Network:
    """table: vector of each byte; a, ab: filters on the vectors of SPAN bytes; e, eb: filters on how
    many of a stretch's bytes equal the one each lag earlier; out, bias: the logistic unit."""

    table: np.ndarray
    a: np.ndarray
    ab: np.ndarray
    e: np.ndarray
    eb: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.a, self.ab, self.e, self.eb, self.out, self.bias]


def fresh(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Network(f(256, WIDTH, by=0.5), f(SPAN * WIDTH, FILTERS, by=0.2), np.zeros(FILTERS, np.float32), f(LAGS, ECHO, by=0.5),
                   np.zeros(ECHO, np.float32), f(2 * (FILTERS + ECHO), by=0.1), np.zeros(1, np.float32))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a run of bytes: where stretches of SPAN start, and for each the share of its bytes that
    equal the one each lag earlier."""
    at = np.arange(0, max(1, len(x) - SPAN + 1), STRIDE)
    same = np.zeros((LAGS, len(at)), np.float32)
    eq = np.zeros((at[-1] + SPAN) // 4 * 4, np.uint8)
    for k in range(LAGS):
        lag, n = k + 2, min(len(x), len(eq))
        eq[:lag] = 0
        if n > lag:
            np.equal(x[lag:n], x[:n - lag], out=eq[lag:n].view(bool))
        four = eq.view(np.uint32) * np.uint32(0x01010101) >> np.uint32(24)  # equal bytes of each four
        same[k] = four[:len(at)] + four[1:len(at) + 1] + four[2:len(at) + 2]
    return at, same.T / np.float32(SPAN)


def _stretches(net: Network, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte vectors of each stretch in a row; `at` goes up by STRIDE."""
    v = net.table[np.concatenate([x, np.zeros(SPAN, np.uint8)])][at[0]:]
    step = v.itemsize
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(v, (len(at), SPAN * WIDTH), (STRIDE * WIDTH * step, step)))


def _pooled(h: np.ndarray, per: int) -> np.ndarray:
    """Greatest response in each chunk of `per` stretches, chunks overlapping by half."""
    half = per // 2
    n = -(-len(h) // half)
    low = np.zeros((n * half, h.shape[1]), h.dtype)
    low[:len(h)] = h  # responses are rectified: 0 is neutral
    halves = low.reshape(n, half, -1).max(axis=1)
    return np.maximum(halves[:-1], halves[1:]) if n > 1 else halves


def features(net: Network, data: bytes) -> np.ndarray | None:
    """Greatest and mean of the chunks' vectors; None for an empty text.  Long texts are read in
    blocks of whole half chunks, so that memory does not grow with the text."""
    if not data:
        return None
    x = np.frombuffer(data, np.uint8)
    top, total, n, last = 0, 0, 0, None
    margin = LAGS + 1
    for a in range(0, len(x), _BLOCK):
        lead = min(a, -(-margin // STRIDE) * STRIDE)
        part = x[a - lead:a + _BLOCK + SPAN - STRIDE]
        at, same = _places(part)
        keep = (at >= lead) & (at < lead + _BLOCK)
        if not keep.any():
            continue
        at, same = at[keep], same[keep]
        h = np.concatenate([np.maximum(_stretches(net, part, at) @ net.a + net.ab, 0), np.maximum(same @ net.e + net.eb, 0)], axis=1)
        if last is not None:
            h = np.concatenate([last, h])
        c = _pooled(h, CHUNK // STRIDE)
        top, total, n = np.maximum(top, c.max(axis=0)), total + c.sum(axis=0), n + len(c)
        half = CHUNK // STRIDE // 2
        last = h[(len(h) - 1) // half * half:]
    return np.concatenate([top, total / n])


def score(net: Network, data: bytes) -> float:
    f = features(net, data)
    z = float(net.bias[0] if f is None else f @ net.out + net.bias[0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Network for texts with labels 0 and 1, by Adam, a text at a time; order and start are fixed."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    net.bias[0] = 0
    m, v, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    order = np.array([i for i, t in enumerate(texts) if t])
    half, batch = CHUNK // STRIDE // 2, 8
    grads = None
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k, i in enumerate(rng.permutation(order)):
            x = np.frombuffer(texts[i], np.uint8)
            at, same = _places(x)
            s = _stretches(net, x, at)
            h = np.concatenate([np.maximum(s @ net.a + net.ab, 0), np.maximum(same @ net.e + net.eb, 0)], axis=1)
            c = _pooled(h, CHUNK // STRIDE)
            f = np.concatenate([c.max(axis=0), c.mean(axis=0)])
            p = 1 / (1 + np.exp(-np.clip(f @ net.out + net.bias[0], -30, 30)))
            dz = np.float32((p - y[i]) * weight[i])
            df = dz * net.out
            # back to the chunk, then to the stretch, that each pooled value came from
            dc = np.repeat(df[None, FILTERS + ECHO:] / len(c), len(c), axis=0)
            dc[c.argmax(axis=0), np.arange(c.shape[1])] += df[:FILTERS + ECHO]
            dh = np.zeros_like(h)
            for j in range(len(c)):
                part = h[j * half:(j + 2) * half]
                dh[j * half + part.argmax(axis=0), np.arange(h.shape[1])] += dc[j]
            dh *= h > 0
            hit = np.flatnonzero(dh[:, :FILTERS].any(axis=1))
            da, de = dh[hit, :FILTERS], dh[:, FILTERS:]
            ds = (da @ net.a.T).reshape(len(hit), SPAN, WIDTH)
            dt = np.zeros_like(net.table)
            pos = at[hit][:, None] + np.arange(SPAN)
            ok = pos < len(x)
            np.add.at(dt, x[np.minimum(pos, len(x) - 1)][ok], ds[ok])
            g = [dt, s[hit].T @ da, da.sum(axis=0), same.T @ de, de.sum(axis=0), dz * f, np.array([dz])]
            grads = g if grads is None else [a + b for a, b in zip(grads, g, strict=True)]
            if (k + 1) % batch == 0 or k + 1 == len(order):
                step += 1
                for q, d, mm, vv in zip(net.parts(), grads, m, v, strict=True):
                    d = d / batch + 1e-4 * q
                    mm += 0.1 * (d - mm)
                    vv += 0.001 * (d * d - vv)
                    q -= (rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                grads = None
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network | float:
    """Network from rows of docs (doc_id, text) with a label in labels (doc_id, label 0 or 1), or the
    share of label 1 where one kind is missing.  The sample's size bounds the one task that fits."""
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label").dropDuplicates(["doc_id"])
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not count.get(0) or not count.get(1):
        return float(1 in count) if count else 0.5
    half = sample // 2
    share = F.when(F.col("label") == 1, max(half, sample - count[0]) / count[1]).otherwise(max(half, sample - count[1]) / count[0])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # about `sample` rows; the limit holds it to that whatever the hash does
    rows = docs.select("doc_id", "text").join(small(saved(picked)), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample + sample // 4)

    def train(batches: Iterator[dict]) -> Iterator[dict]:
        texts, y = [], []
        for b in batches:
            texts += [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            y += b["label"]
        if len(set(y)) == 2:
            net = fit(texts, y, epochs)
            yield {"part": list(range(7)), "cells": [p.tobytes() for p in net.parts()]}

    got = map_columns(rows.repartition(1), train, "part int, cells binary").collect()
    if not got:
        return count[1] / (count[0] + count[1])
    net, cells = fresh(), {r["part"]: r["cells"] for r in got}
    return Network(*(np.frombuffer(cells[i], np.float32).reshape(p.shape) for i, p in enumerate(net.parts())))


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of docs (doc_id, text)."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            s = [model if isinstance(model, float) else score(model, t.encode("utf-8", "surrogatepass") if t else b"") for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, score double, predicted int")
