"""Vectorised word and shingle hashes of whole texts (numpy over one Arrow batch at a time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True  # what [^\x20\x09-\x0D]+ leaves out
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def word_hashes(data: list[bytes], between: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the texts joined, number of words before each text and in all).

    A word is a run of bytes other than those `between` words, here space and \\x09-\\x0D (a space must
    be one); A-Z count as a-z."""
    buf = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    sep = between[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(buf))
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * up, dtype=np.uint64)])
    h = mix((run[end] - run[start]) * down[start])
    at = np.cumsum([1] + [len(x) + 1 for x in data])
    return h, np.searchsorted(start, at)


def shingle_hashes(data: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each n-word shingle, number of shingles before each text and in all).

    A text with fewer than n words but at least one has its whole sequence as its one shingle."""
    w, at = word_hashes(data)
    count = np.diff(at)
    long, short = count >= n, (count > 0) & (count < n)
    if len(w) >= n:
        h = np.zeros(len(w) - n + 1, np.uint64)
        for j in range(n):
            h += w[j:len(w) - n + 1 + j] * _PLACE[j]
        owner = np.repeat(np.arange(len(count)), count)
        h = mix(h[owner[:len(h)] == owner[n - 1:]])
    else:
        h = np.zeros(0, np.uint64)
    sizes = np.where(long, count - n + 1, 0)
    if short.any():
        out = np.concatenate([[0], np.cumsum(np.where(short, 1, sizes))])
        full = np.zeros(out[-1], np.uint64)
        full[np.repeat(long, np.where(short, 1, sizes))] = h
        for i in np.flatnonzero(short):
            part = w[at[i]:at[i + 1]]
            full[out[i]] = mix(np.array([(part * _PLACE[:len(part)]).sum(dtype=np.uint64) ^ _PLACE[32 + len(part)]]))[0]
        return full, out
    return h, np.concatenate([[0], np.cumsum(sizes)])


def in_chunks(texts, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of runs of about `limit` bytes; null is empty."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if part and size + len(b) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(b)
        size += len(b) + 1
    if part:
        yield first, part
