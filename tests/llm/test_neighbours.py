"""Near-duplicate operators against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from weftview.llm.components import connected_components
from weftview.llm.embed_neardup import near_duplicates
from weftview.llm.ngram_join import jaccard_components
from weftview.llm.shingles import shingle_hashes

WORDS = [f"w{i}" for i in range(60)]


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [500_000, 20])
def test_components_of_chain_star_and_loop(spark, block):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, None), (301, 302), (302, 301), (301, 302)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "a long, b long"), block=block).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 302: 301}


def test_components_of_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_words_of_the_whole_text():
    h, at = shingle_hashes([b"A b c d e f", b"", b"a  B\tc d\ne f", b"a b", b"a b c", b"\x20\x0b"])
    assert np.diff(at).tolist() == [2, 0, 2, 1, 1, 0]
    assert h[0:2].tolist() == h[2:4].tolist() and len(set(h.tolist())) == 4


def _texts(seed):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    out = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        if rng.random() < 0.2:
            w = w + rng.choice(base)[:3]
        out.append(" ".join(w))
    return out + ["", None, "  \n", "one", "ONE", "one two", "x " * 30_000]


@pytest.mark.parametrize("seed,cells", [(1, 1 << 20), (2, 8)])
def test_jaccard_join_equals_brute_force(spark, seed, cells):
    texts = _texts(seed)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _components(len(texts), links)
    rows = [(i, t, "en", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long").repartition(7)
    got = {r.doc_id: r for r in jaccard_components(docs, cells=cells).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert len({w for w in want}) < len(texts) - 50


def test_jaccard_join_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_components(docs).collect())
    assert got == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(30):
        c = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            rows.append((i, (c + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25, 0.5])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    same = rng.standard_normal(32).astype(np.float32).tolist()
    rows += [(i + k, same, 1) for k in range(50)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0, None] + [0.0] * 30, 1), (904, [float("nan")] * 32, 1),
           (905, [float("inf")] * 32, 1), (906, same, None), (907, same[:31], 1), (908, [x * 4 for x in same], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, c string")
    got = {r.vec_id: r for r in near_duplicates(df, block=16).collect()}
    good = [(v, np.array(e, np.float64), y) for v, e, y in rows + odd[-1:]]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    ids = sorted(got)
    want = dict(zip(ids, (ids[k] for k in _components(len(ids), [(ids.index(a), ids.index(b)) for a, b in links])), strict=True))
    degree = {v: sum(v in ab for ab in links) for v in ids}
    assert {v: got[v].component_id for v in ids} == want
    assert {v: got[v].n_links for v in ids} == degree
    assert all(got[v].kept == (want[v] == v) for v in ids)
    assert all(got[v].n_links == 0 for v in range(900, 908))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
