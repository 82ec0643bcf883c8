"""Toxicity by noisy-channel deobfuscation.

1. *Language model.*  Counts of three successive characters inside words are summed over the whole
   corpus (SYMBOLS ** 3 cells): letters a to z, classes of other letters, and the word's edge.
2. *Lattice.*  A word with signs, digits or punctuation between or before letters, a letter twice in
   a row or more, or a run of single characters and signs with separators is a noisy observation.  Each
   of its characters may stand for itself or for the letters that it is written for (LEET); a run
   of one character for one or two of them; a separator for nothing or for a word's end.  The
   Viterbi path of least cost (model bits and channel bits) is the restored word.
3. *Score.*  A text counts once for each distinct restored word and its first 4 and 5 letters.  Their
   log odds are learned from labelled texts; the text's evidence - the greatest log odds and the
   sum of its three greatest - enters a logistic curve fitted on the same texts.

Everything that is not noisy is its own restoration: its lattice has one path.  Null and empty texts
have no word and get the curve's value without evidence.  Without labelled rows of both kinds
every score is the share of label 1 (0 without any).  Repeated rows give repeated results; extra columns are
never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_rows, map_columns, saved, small, summed_cells

#: Letters that a character is written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
EDGE, SYMBOLS = 0, 36
SWAP_BITS, TWICE_BITS, EDGE_BITS = 1.0, 1.0, 2.0
SAMPLE = 20_000
LEAST_TEXTS = 4
#: Restorations that a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 200_000

_AROUND = ".,;:!?\"'()[]{}<>|/\\-_*&#%$~`=+«»„“”…"
_EDGES = re.compile(r"([!$*#%&@|+~])\1+$")
_TWICE = re.compile(r"([^\W\d_])\1")
_BETWEEN, _INSIDE = " .-_*/", ".,;:?\"'()[]{}<>/\\_=~`-"
_ONE = r"(?:[^\W_]|[@$!|+(€£¡#])"
_SPACED = re.compile(rf"(?<![^\W_]){_ONE}(?:[ .\-_*/]+{_ONE}){{2,}}(?![^\W_])")
_PARTS = re.compile(r"[.,;:?\"'()\[\]{}<>/\\_=~`-]+")


def symbol(c: str) -> int:
    """Number of a letter in the model: 1 to 26, classes of other letters above."""
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % (SYMBOLS - 27)


def _counted(docs: DataFrame) -> np.ndarray:
    """How often three characters follow each other in words, edges included, over all texts."""
    table = np.zeros(0x250, np.int64)
    for o in range(0x250):
        c = chr(o).lower()
        table[o] = symbol(c) if len(c) == 1 and c.isalpha() else 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for text in b["text"]:
                if not text:
                    continue
                for a in range(0, len(text), 1 << 20):
                    part = text[max(0, a - 2):a + (1 << 20)]
                    o = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                    x = np.where(o < 0x250, table[np.minimum(o, 0x24F)], 27 + o.astype(np.int64) % (SYMBOLS - 27))
                    if not a:
                        x = np.concatenate([[0, 0], x])
                    if a + (1 << 20) >= len(text):
                        x = np.append(x, 0)
                    total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
        yield cell_rows(total)

    return summed_cells(docs.select("text").mapInPandas(count, "chunk int, cells binary"))


@dataclass
class Restorer:
    """bits: cost of a symbol after two others."""

    bits: np.ndarray
    kept: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> Restorer:
        c = (counts if len(counts) else np.zeros(SYMBOLS**3)).reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = (c.sum(axis=0) + 4 * one) / (c.sum(axis=(0, 2))[:, None] + 4)
        three = (c + 4 * two[None]) / (c.sum(axis=2, keepdims=True) + 4)
        return cls((-np.log2(three)).astype(np.float32))

    def lattice(self, seen: str) -> list[list[tuple[str, float]]]:
        """For each run of one character in `seen` what it may stand for, with channel bits; a
        space stands for a word's end."""
        out, i, spaced = [], 0, _SPACED.fullmatch(seen)
        while i < len(seen):
            c, j = seen[i], i
            while j < len(seen) and seen[j] == c:
                j += 1
            arcs: list[tuple[str, float]] = []
            if spaced and c in _BETWEEN or c in _INSIDE:
                arcs = [("", 0.0), (" ", EDGE_BITS)] + [(x, SWAP_BITS) for x in LEET.get(c, "")]
            else:
                plain = [(c, 0.0)] if c.isalpha() else []
                for letter, bits in plain + [(x, SWAP_BITS) for x in LEET.get(c, "")]:
                    arcs.append((letter, bits + (TWICE_BITS if j - i > 2 else 0.0 if j - i == 1 else TWICE_BITS / 2)))
                    if j - i > 1:
                        arcs.append((letter * 2, bits))
                arcs = arcs or [("", 0.0)]
            out.append(arcs)
            i = j
        return out

    def decode(self, seen: str) -> str:
        """Output of the least path through the lattice (the first in text order on a tie)."""
        best: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
        done = []
        for k, arcs in enumerate(self.lattice(seen)):
            if k % 64 == 63:  # what all paths begin with is settled: time stays in proportion
                done.append(commonprefix([text for _, text in best.values()]))
                best = {s: (cost, text[len(done[-1]):]) for s, (cost, text) in best.items()}
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (p, q), (cost, text) in best.items():
                for out, bits in arcs:
                    a, b, c = p, q, cost + bits
                    for x in out:
                        s = EDGE if x == " " else symbol(x)
                        c += float(self.bits[a, b, s])
                        a, b = (EDGE, EDGE) if s == EDGE else (b, s)
                    new = (c, text + out)
                    if (a, b) not in step or new < step[a, b]:
                        step[a, b] = new
            best = step
        return "".join(done) + min((cost + float(self.bits[p, q, EDGE]), text) for (p, q), (cost, text) in best.items())[1]

    def restored(self, seen: str) -> list[str]:
        if seen not in self.kept:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            self.kept[seen] = self.decode(seen).split()
        return self.kept[seen]

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a whole text."""
        text = text.lower()
        out: set[str] = set()
        for m in _SPACED.finditer(text):
            if sum(c.isalpha() for c in m[0]) > 1:
                out.update(self.restored(m[0]))
        for w in set(text.split()):
            if not w.isalpha():
                w = _EDGES.sub("", w)
                core = w.strip(_AROUND)
                if not core.isalpha():
                    # parts between punctuation are words; a part with letters and signs is noisy
                    parts = _PARTS.split(w)
                    if sum(any(c.isalpha() or c in LEET for c in part) for part in parts) > 1 and any(map(str.isalpha, w)):
                        out.update(self.restored(w.strip(_INSIDE)))  # parts of one word, or words
                    for part in parts:
                        if part.isalpha():
                            out.add(part)
                        elif any(map(str.isalpha, part)) or sum(c in LEET for c in part) > 2 and not part.isdigit():
                            out.update(self.restored(part))
                    continue
                if core != w and w[0] in LEET:  # a sign that a word begins with may be a letter
                    out.update(self.restored(w[:w.find(core) + len(core)]))
                w = core
            out.add(w)
        if _TWICE.search(text):
            for w in [w for w in out if _TWICE.search(w)]:
                out.update(self.restored(w))
        return out


def evidence(words: set[str], weights: dict[str, float]) -> tuple[float, float]:
    """Greatest log odds of the words and their beginnings, and the sum of the three greatest."""
    found = []
    for w in words:
        if len(w) < 3:
            continue
        hit = max(weights.get(w, 0.0), weights.get("^" + w[:5], 0.0), weights.get("^" + w[:4], 0.0))
        if hit > 0:
            found.append(hit)
    found.sort(reverse=True)
    return (found[0], sum(found[:3])) if found else (0.0, 0.0)


def _features(words: set[str]) -> set[str]:
    return {f for w in words if len(w) > 2 for f in (w, "^" + w[:5], "^" + w[:4])}


@dataclass
class Model:
    bits: np.ndarray
    weights: dict[str, float]
    curve: tuple[float, float, float]


def log_odds(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: int = LEAST_TEXTS) -> dict[str, float]:
    """Weight of features in `least` texts or more that are clearly more frequent in toxic ones."""
    out = {}
    for f, t, c in counts:
        if t >= least:
            w = math.log((t + 0.1) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            if w > 1.5:
                out[f] = w
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps with a small penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(3)
        w = w - np.linalg.solve(h, a.T @ (p - y) + 0.01 * w)
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """Model from docs (doc_id, text), all of them for the language model, and the labels (doc_id,
    label 0 or 1) that may be learned from: about `sample` of them, picked by a hash of the id."""
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label").dropDuplicates(["doc_id"])
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not count.get(0) or not count.get(1):
        return float(1 in count)
    bits = Restorer.of(_counted(docs)).bits
    share = min(1.0, sample / (count[0] + count[1]))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = saved(docs.select("doc_id", "text").join(small(saved(picked)), "doc_id").select("text", "label"))  # read twice

    def count_features(batches: Iterator[dict]) -> Iterator[dict]:
        r, seen = Restorer(bits), {0: Counter(), 1: Counter()}
        n = Counter()
        for b in batches:
            for text, y in zip(b["text"], b["label"], strict=True):
                seen[y].update(_features(r.words(text or "")))
                n[y] += 1
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield _rows(seen)
        yield _rows(seen)
        yield {"f": [""] , "t": [n[1]], "c": [n[0]]}

    def _rows(seen: dict) -> dict:
        fs = list(seen[0].keys() | seen[1].keys())
        out = {"f": fs, "t": [seen[1][f] for f in fs], "c": [seen[0][f] for f in fs]}
        seen[0].clear()
        seen[1].clear()
        return out

    sums = map_columns(rows, count_features, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # a feature needs several texts of a bounded sample, and more toxic ones than clean ones by share
    got = sums.where(f"f = '' or t >= {LEAST_TEXTS} and t * {count[0]} > 3 * c * {count[1]}").collect()
    total = next((r for r in got if r["f"] == ""), None)
    weights = log_odds([(r["f"], r["t"], r["c"]) for r in got if r["f"]], total["t"], total["c"]) if total else {}

    def held(batches: Iterator[dict]) -> Iterator[dict]:
        r = Restorer(bits)
        for b in batches:
            e = [evidence(r.words(t or ""), weights) for t in b["text"]]
            yield {"x": [v[0] for v in e], "s": [v[1] for v in e], "y": b["label"]}

    seen = map_columns(rows, held, "x double, s double, y int").toPandas()
    if seen["y"].nunique() < 2:
        return count[1] / (count[0] + count[1])
    return Model(bits, weights, _curve(seen[["x", "s"]].to_numpy(), seen["y"].to_numpy()))


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of docs (doc_id, text)."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        r = None if isinstance(model, float) else Restorer(model.bits)
        for b in batches:
            out = []
            for t in b["text"]:
                if r is None:
                    out.append(model)
                    continue
                x, s = evidence(r.words(t or ""), model.weights)
                z = model.curve[0] + model.curve[1] * x + model.curve[2] * s
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield {"doc_id": b["doc_id"], "score": out, "predicted": [int(x >= 0.5) for x in out]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, score double, predicted int")
