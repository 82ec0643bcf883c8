"""Merkle manifest: digests, proofs and folds against a tree built with hashlib."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftview.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """(top, siblings of each bottom node from the bottom up as (left, right) lists of digests)."""
    ups = [[] for _ in nodes]
    at, k = list(nodes), 0
    while len(at) > 1:
        for i in range(len(nodes)):
            j = i // 8**k
            run = at[j // 8 * 8:j // 8 * 8 + 8]
            ups[i].append((run[:j % 8], run[j % 8 + 1:]))
        at = [_h(*at[i:i + 8]) for i in range(0, len(at), 8)]
        k += 1
    return at[0], ups


def brute(rows, change):
    """Rows of `verified` by doc_id, leaf; `change` maps a row's text to what it is now."""
    langs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))):
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    if not rows:
        return []
    trees = {x: _tree([_leaf(r) for r in langs[x]]) for x in order}
    root, tops = _tree([trees[x][0] for x in order])
    out = []
    for i, x in enumerate(order):
        for r, low in zip(langs[x], trees[x][1], strict=True):
            at = _leaf((*r[:4], change(r)))
            path = low + tops[i]
            for left, right in path:
                at = _h(*left, at, *right)
            out.append((r[0], _leaf(r), trees[x][0], root, _h(*(d for s in path for side in s for d in side)), at, at == root))
    return sorted(out, key=str)


def _rows(seed):
    rng = random.Random(seed)
    langs = ["de", "en", "en", "en", "en", None, "é", "zz", ""]
    out = [(i, rng.choice(["web", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["Ab é", "lower", "", None, f"Text {i}"])) for i in range(500)]
    out += [out[3], out[3], (None, None, None, None, None), (None, "web", "en", 1, "X"), (out[5][0], "other", out[5][2], 9, "tie")]
    out += [(7, "web", "en", 1, "copy")] * 70
    out += [(1000 * n + i, "s", f"l{n}", i, "A" * (100_000 if n == 1 else 3)) for n in (1, 7, 8, 9, 64, 65) for i in range(n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [[], [(4, "s", None, 1, "One")], _rows(1)])
def test_proofs_equal_a_tree_built_by_hand(spark, rows):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], DOC + ", idx int, digest string").repartition(5)
    now = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    got = sorted((tuple(r) for r in merkle.verified(docs, now).collect()), key=str)
    assert got == brute(rows, lambda r: r[4].lower() if r[0] is not None and r[0] % 2 == 0 and r[4] else r[4])


def test_requests_for_some_leaves_find_the_same_paths(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(300)]
    leaves = merkle.ranked(merkle.leaf_rows(spark.createDataFrame(rows, DOC)), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    tree = merkle.build(leaves)
    starts = tree.tops.withColumn("path", F.expr(f"cast(array() as {merkle.SEGMENTS})"))
    wanted = leaves.where(F.col("doc_id").isin(0, 77, 299))
    runs = merkle.descend(tree, starts, [], wanted)
    assert runs.count() == 3
    got = merkle.selected(runs, wanted, ["doc_id"], []).withColumn("path", F.reverse("path"))
    top, ups = _tree([_leaf(r) for r in rows])
    for r in got.withColumn("top", F.hex(merkle.folded(F.col("digest"), F.col("path")))).collect():
        assert r.top.lower() == top and r.digest.hex() == _leaf(rows[r.doc_id])
        assert [(s.left.hex(), s.right.hex()) for s in r.path] == [("".join(a), "".join(b)) for a, b in ups[r.doc_id]]
