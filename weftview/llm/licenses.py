"""License scan by a positional index of rare template words.

1. *Counts.*  How many documents hold each template word, over all documents (a row per word comes
   to the driver; the words are the templates').  IDF = log((documents + 1) / (holders + 1)).
2. *Look-up.*  For each template whose mandatory words all occur, the file's RARE words of highest IDF
   among the template's are looked up; each occurrence votes for where the template would begin
   (its place in the file minus a place in the template's postings).
3. *Intersection.*  A start is a candidate if at least two different rare words agree on it, up to
   SLACK words; a template with one word needs one.
4. *Verification.*  Every mandatory phrase must stand, word after word, within SLACK of its place, and
   the share of the template's words found at their places must reach SHARE.  Words are compared
   as bytes, so that a shared hash finds nothing.

Base phrases are counted at every place; a document's labels are the base labels and those of its
verified templates, and its score the largest share of a verified template or 1 for a base phrase,
which is a template found in full (0 without any).

Texts are whole and never cross batches; nulls are empty texts: no words, no labels, null ends.
Repeated rows and ids give repeated results; rows without an id are returned too.  Ties of IDF go by
the word.  Empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .shingles import in_chunks, word_hashes

RARE, SLACK, SHARE = 6, 4, 0.75

# The phrases every scan counts, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, notice, mandatory phrases (wording of the public licenses and of usual notices).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software", ["free of charge", "without restriction", "sublicense and or sell copies"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the terms of the MIT license", ["mit license"]),
    ("mit", "SPDX-License-Identifier: MIT", ["identifier mit"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ["identifier apache 2 0"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["applicable law", "without warranties or conditions of any kind"]),
    ("gpl", "licensed under the GNU General Public License", ["general public license"]),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation", ["free software", "gnu general public license"]),
    ("gpl", "SPDX-License-Identifier: GPL", ["identifier gpl"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ["source and binary forms", "with or without modification"]),
    ("bsd", "Licensed under the BSD 3-Clause License", ["bsd 3 clause"]),
    ("bsd", "Licensed under the BSD 2-Clause License", ["bsd 2 clause"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["and or distribute this software", "with or without fee"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl", "made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software", ["provided as is", "in no event will the authors"]),
    ("cc0", "Creative Commons Zero CC0 1.0 Universal", ["cc0 1 0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "Creative Commons Attribution 4.0 International License", ["commons attribution 4 0"]),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike"]),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial"]),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License", ["attribution noderivatives"]),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited", ["unauthorized copying", "strictly prohibited"]),
]

#: What the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text leave out, as bytes.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Block(NamedTuple):
    """The words of some texts: hash, first byte and end of each, words before each text and in all."""

    buf: bytes
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].lower()  # bytes.lower() changes A-Z only


def block(data: list[bytes]) -> Block:
    buf = b" " + b" ".join(data) + b" "
    sep = BETWEEN[np.frombuffer(buf, np.uint8)]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    hashes, at = word_hashes(data, BETWEEN)
    return Block(buf, hashes, edge[::2], edge[1::2], at)


class Index(NamedTuple):
    """`words` in the order of their hashes; templates as (label, words as numbers, phrases as (place, numbers))."""

    words: list[bytes]
    hashes: np.ndarray
    templates: list[tuple[str, np.ndarray, list[tuple[int, np.ndarray]]]]
    base: list[tuple[str, np.ndarray]]


def _words(text: str) -> list[bytes]:
    b = block([text.encode()])
    return [b.word(i) for i in range(len(b.start))]


def index(templates=TEMPLATES, base=BASE) -> Index:
    spelt = [(label, _words(text), [_words(p) for p in phrases]) for label, text, phrases in templates]
    vocabulary = sorted({w for _, words, phrases in spelt for w in [*words, *(x for p in phrases for x in p)]} | {w for p, _ in base for w in _words(p)})
    hashes = np.concatenate([block([w]).hashes for w in vocabulary])
    order = np.argsort(hashes)
    words = [vocabulary[i] for i in order]
    number = {w: i for i, w in enumerate(words)}
    out = []
    for label, text, phrases in spelt:
        places = []
        for p in phrases:
            at = [i for i in range(len(text)) if text[i:i + len(p)] == p]
            if not at:
                raise ValueError(f"{label}: its notice has no {p}")
            places.append((at[0], np.array([number[w] for w in p])))
        out.append((label, np.array([number[w] for w in text]), places))
    return Index(words, hashes[order], out, [(label, np.array([number[w] for w in _words(p)])) for p, label in base])


def hits(b: Block, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """(place among the block's words, number of the template word) wherever one stands."""
    k = np.minimum(np.searchsorted(ix.hashes, b.hashes), len(ix.hashes) - 1)
    place = np.flatnonzero(ix.hashes[k] == b.hashes)
    word = k[place]
    return place, word


def holders(docs: DataFrame, ix: Index) -> tuple[np.ndarray, int]:
    """(documents that hold each word, documents), over all rows of `docs` (text)."""

    def count(parts: Iterator[dict]) -> Iterator[dict]:
        held, seen = np.zeros(len(ix.words), np.int64), 0
        for p in parts:
            seen += len(p["text"])
            for _, data in in_chunks(p["text"]):
                b = block(data)
                place, word = hits(b, ix)
                text = np.searchsorted(b.at, place, side="right") - 1
                held += np.bincount(np.unique(text * len(ix.words) + word) % len(ix.words), minlength=len(ix.words))
        yield {"word": np.arange(len(held) + 1), "n": np.append(held, seen)}

    got = map_columns(docs.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(ix.words) + 1, np.int64)
    for r in got:
        n[r["word"]] = r["n"]
    return n[:-1], int(n[-1])


def _near(at: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Whether any of the sorted `at` lies from each of `low` to `width` beyond it."""
    k = np.searchsorted(at, low)
    return (k < len(at)) & (at[np.minimum(k, len(at) - 1)] <= low + width) if len(at) else np.zeros(len(low), bool)


def _aligned(place: np.ndarray, word: np.ndarray, template: np.ndarray, phrases: list, idf: np.ndarray) -> float:
    """The largest share of a verified alignment of the template with a text's hits, else 0."""
    mine = np.unique(template)
    here = mine[np.isin(mine, word)]
    rare = here[np.lexsort((here, -idf[here]))][:RARE]
    votes = [np.unique(np.subtract.outer(place[word == w], np.flatnonzero(template == w))) for w in rare]
    start = np.unique(np.concatenate(votes))
    start = start[sum(_near(v, start, SLACK).astype(int) for v in votes) >= min(2, len(mine))]
    for i, phrase in phrases:
        start = start[_near(_runs(place, word, phrase), start + i - SLACK, 2 * SLACK)]
    if not len(start):
        return 0.0
    found = sum(_near(place[word == w], start + i - SLACK, 2 * SLACK).astype(int) for i, w in enumerate(template))
    share = float(found.max()) / len(template)
    return share if share >= SHARE else 0.0


def _runs(place: np.ndarray, word: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after the other: the places of its first word."""
    at = place[word == phrase[0]]
    for k, w in enumerate(phrase[1:], 1):
        at = at[np.isin(at + k, place[word == w])]
    return at


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, ix: Index | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), as OUT names it."""
    ix = ix or index()
    held, n = holders(docs, ix)
    idf = np.array([math.log((n + 1) / (h + 1)) for h in held])
    needs = [np.unique(np.concatenate([p for _, p in phrases])) for _, _, phrases in ix.templates]
    # words that some phrase starts with pick out the few texts that are looked at one by one
    first = np.unique(np.array([x for x in (*(min(need, key=lambda w: held[w]) for need in needs), *(p[0] for _, p in ix.base))]))

    def text_row(place: np.ndarray, word: np.ndarray) -> tuple:
        runs = [(label, _runs(place, word, p)) for label, p in ix.base]
        base = {label for label, at in runs if len(at)}
        places = np.concatenate([at for _, at in runs])
        shares = {}
        for (label, template, phrases), need in zip(ix.templates, needs, strict=True):
            if np.isin(need, word).all() and (share := _aligned(place, word, template, phrases, idf)):
                shares[label] = max(share, shares.get(label, 0))
        ends = (int(places.min()), int(places.max())) if len(places) else (None, None)
        return len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | set(shares))), max([float(bool(base)), *shares.values()])

    def scan(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            rows = []
            for _, data in in_chunks(p["text"]):
                b = block(data)
                place, word = hits(b, ix)
                cuts = np.searchsorted(place, b.at)
                looked = set((np.searchsorted(b.at, place[np.isin(word, first)], side="right") - 1).tolist())
                for i in range(len(data)):
                    n_words = int(b.at[i + 1] - b.at[i])
                    if i not in looked:
                        rows.append((n_words, 0, None, None, "", "", 0.0))
                        continue
                    at, w = place[cuts[i]:cuts[i + 1]], word[cuts[i]:cuts[i + 1]]
                    same = np.array([b.word(a) == ix.words[k] for a, k in zip(at, w, strict=True)], bool)
                    rows.append((n_words, *text_row(at[same] - b.at[i], w[same])))
            yield dict(zip([f.split()[0] for f in OUT.split(", ")], [p["doc_id"], *(zip(*rows, strict=True) if rows else [[]] * 7)], strict=True))

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, OUT)
