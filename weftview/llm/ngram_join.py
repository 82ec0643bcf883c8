"""N-gram Jaccard join by grouped prefixes.

Texts become sets of word shingles.  In one total order of all shingles (seldom ones first) two
sets of Jaccard similarity t or more share a shingle among the first ``n - ceil(t n) + 1`` of
each: their prefixes.

1. *Order.*  Every task counts its shingles in a fixed array of cells; the sum over the corpus
   orders shingles by how far their cell stands out, then by hash.  Any such order is exact;
   the counts only keep passages that many documents share out of the prefixes.
2. *Groups.*  Documents of equal size and prefix form a group, those with equal sets one class
   in it (copies are collapsed here, never paired).
3. *Group pairs.*  Each prefix shingle lists its groups.  First each group is compared with
   NEAR[0] others of its size in a list (and neighbouring classes in a group), then with NEAR[1]
   others of another component, in lists that hold several; at last, in lists and groups that still do,
   every pair of groups across components is compared.  A pair within one component can't change
   the components, so a group of near copies costs work in proportion to its members, and no link
   between components is lost.  Pairs must pass the size and position filters, then a comparison
   of the prefixes.
4. *Verify.*  Pairs are expanded to classes and compared on their whole shingle sets.

Null, empty and wordless texts have size 0 and no link; a row without a doc_id is returned and
links with nothing.  Repeated rows give repeated results; an id must not stand for two texts.
Extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_batches, map_columns, saved, small, summed_cells
from .components import connected_components
from .shingles import in_chunks, mix, shingle_hashes

CELLS = 1 << 22
NEAR = (4, 16)
#: Bytes of text hashed at once; the arrays for it take about 60 times that.
PART = 1 << 18
_SETS = "doc_id long, n long, set1 long, set2 long, grp1 long, grp2 long, prefix array<long>"


def _counted(docs: DataFrame, words: int, cells: int) -> np.ndarray:
    """How often shingles fall in each cell, over all documents."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(cells, np.uint32)
        for b in batches:
            for _, data in in_chunks(b["text"], PART):
                h, _ = shingle_hashes(data, words)
                at, n = np.unique((h >> np.uint64(40)) % np.uint64(cells), return_counts=True)
                total[at] += n.astype(np.uint32)
        yield from cell_batches(total)

    return summed_cells(map_columns(docs.select("text"), count, "chunk int, cells binary"))


def _levels(cells: np.ndarray) -> np.ndarray:
    """0 for a cell that doesn't stand out of the mean count, then one more for each doubling."""
    if not len(cells):
        return np.zeros(1, np.uint8)
    mean = cells.mean()
    over = np.maximum(0, cells - mean) / (1 + 2 * math.sqrt(mean))
    return np.minimum(15, np.log2(1 + over)).astype(np.uint8)


def _ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingle hashes as sort keys: level in the top 4 bits, 60 bits of the hash below."""
    at = (h >> np.uint64(40)).astype(np.int64) % len(levels)
    return np.unique((levels[at].astype(np.uint64) << np.uint64(60)) | (h & np.uint64((1 << 60) - 1)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for first, data in in_chunks(b["text"], PART):
                h, at = shingle_hashes(data, words)
                rows = []
                for i in range(len(data)):
                    k = _ordered(h[at[i]:at[i + 1]], levels)
                    p = k[:prefix_length(len(k), percent)] if len(k) else k
                    two = [int(f(x).sum(dtype=np.uint64).astype(np.int64)) for x in (k, p)
                           for f in (mix, lambda y: mix(y ^ np.uint64(0x5851F42D4C957F2D)))]
                    rows.append((b["doc_id"][first + i], len(k), *two, p.view(np.int64)))
                yield dict(zip(("doc_id", "n", "set1", "set2", "grp1", "grp2", "prefix"), zip(*rows), strict=True))

    return map_columns(docs.select("doc_id", "text"), each, _SETS)


def _fits(n1, at1, n2, at2, percent: int):
    """Size and position filters: whether sets of n1 and n2 shingles whose first common one comes
    after at1 and at2 others can be similar enough."""
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - at1, n2 - at2) * (100 + percent) >= (n1 + n2) * percent)


def _neighbours(lists: DataFrame, turn: int, near: int, percent: int) -> DataFrame:
    """Pairs (gx, gy) of each group with up to `near` others of its size before it in each list
    (key, g, n, at, lo, hi), in an order that is new each turn and the same in all lists, but no
    pair of groups within one component (lo to hi)."""
    order = Window.partitionBy("key").orderBy(F.floor(F.log("n") * 5), F.xxhash64("g", F.lit(turn)), "g")
    cols = ["g", "n", "at", "lo", "hi"]
    before = F.array(*(F.lag(F.struct(*cols), k).over(order) for k in range(1, near + 1)))
    pairs = lists.select(*cols, before.alias("before")).select(*cols, F.explode("before").alias("o")).where("o is not null and o.g <> g")
    return (pairs.where("not (lo = hi and o.lo = o.hi and lo = o.lo)")
            .where(_fits(F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at"), percent))
            .select(F.least("g", "o.g").alias("gx"), F.greatest("g", "o.g").alias("gy")).distinct())


def _plausible(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of group pairs (gx, gy) whose prefixes don't differ in more shingles than two similar
    sets may in all; up to the smaller of their last keys, prefixes show each set in full."""
    pairs = saved(pairs)
    ids = pairs.select(F.col("gx").alias("doc_id")).union(pairs.select("gy")).distinct()
    known = sets.select("doc_id", "n", "prefix").join(small(ids), "doc_id", "left_semi")
    both = (pairs.join(known.toDF("gx", "nx", "x"), "gx").join(known.toDF("gy", "ny", "y"), "gy"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("x", "y"))
                top = min(x[-1], y[-1])
                x, y = x[:np.searchsorted(x, top, "right")], y[:np.searchsorted(y, top, "right")]
                apart = 2 * len(np.union1d(x, y)) - len(x) - len(y)
                size = b.column("nx")[i].as_py() + b.column("ny")[i].as_py()
                keep.append(apart * (100 + percent) <= size * (100 - percent))
            yield b.filter(pa.array(keep, pa.bool_())).select(["gx", "gy"])

    return saved(both.select("gx", "gy", "nx", "x", "ny", "y").mapInArrow(each, "gx long, gy long").distinct())


def _mixed(lists: DataFrame, classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (key, g, n, at, lo, hi) of the lists that hold more than one component by `links`;
    classes with their component (c, g, n, comp); groups with their least and last component."""
    parts = connected_components(links)
    of = saved(classes.join(parts, classes["c"] == parts["id"], "left")
               .select("c", "g", "n", F.coalesce("component_id", "c").alias("comp")))
    spans = of.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    member = lists.select("key", "g", "n", "at").join(spans, "g")
    mixed = member.groupBy("key").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("key")
    return saved(member.join(mixed, "key", "left_semi")), of, spans


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of class ids whose whole sets are similar enough."""
    pairs = saved(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for first, data in in_chunks(b["text"], PART):
                h, at = shingle_hashes(data, words)
                yield {"doc_id": b["doc_id"][first:first + len(data)],
                       "keys": [np.unique(h[at[i]:at[i + 1]]).tobytes() for i in range(len(data))]}

    texts = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    sets = saved(map_columns(texts, each, "doc_id long, keys binary"))
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("y")), "b"))

    def similar(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    keep.append(i)
            yield {c: [b[c][i] for i in keep] for c in ("a", "b")}

    return saved(map_columns(both.select("a", "b", "x", "y"), similar, "a long, b long"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, cells: int = CELLS) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one per row of `docs` (doc_id, text).

    class_id is the smallest doc_id with the same set, component_id the smallest reachable by
    links of similarity percent/100 or more; both are the doc_id itself for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = _levels(_counted(docs, words, cells))
    sets = saved(_sets(docs, words, percent, levels))

    # classes (equal sets) and groups (equal prefix and size), named by their smallest doc_id
    classes = (sets.where("n > 0").groupBy("n", "set1", "set2", "grp1", "grp2").agg(F.min("doc_id").alias("c")))
    groups = classes.groupBy("n", "grp1", "grp2").agg(F.min("c").alias("g"))
    classes = saved(classes.join(groups, ["n", "grp1", "grp2"]).select("c", "g", "n", "set1", "set2"))
    reps = classes.where("c = g").select(F.col("g").alias("doc_id"))
    lists = (sets.where("n > 0").select("doc_id", "n", "prefix").join(reps, "doc_id", "left_semi")
             .select(F.posexplode("prefix").alias("at", "key"), F.col("doc_id").alias("g"), "n"))

    by_key = Window.partitionBy("key").orderBy("n", "g")
    lists = lists.select("key", "g", "n", "at", F.lag("g").over(by_key).alias("g0"), F.lead("g").over(by_key).alias("g1"))
    # a shingle of one group's prefix alone pairs nothing
    lists = saved(lists.where("g0 is not null or g1 is not null").drop("g0", "g1"))
    fits = lambda x, y: _fits(*(F.col(c + s) for s in (x, y) for c in ("n", "at")), percent)

    # neighbours in each list and in each group, then more of them where a list has several components
    inner = (classes.select(F.lag("c").over(Window.partitionBy("g").orderBy("c")).alias("a"), F.col("c").alias("b"))
             .where("a is not null"))
    alone = lists.withColumns({"lo": F.col("g"), "hi": F.col("g")})
    near = _plausible(sets, _neighbours(alone, 0, NEAR[0], percent), percent)
    links = _verified(docs, near.toDF("a", "b").union(inner).distinct(), words, percent)
    for turn in range(1, len(NEAR)):
        member, _, _ = _mixed(lists, classes, links)
        near = _plausible(sets, _neighbours(member, turn, NEAR[turn], percent), percent)
        links = saved(links.union(_verified(docs, near.toDF("a", "b"), words, percent)).distinct())

    # the rest: every pair across components
    member, of, spans = _mixed(lists, classes, links)
    x = member.select("key", *(F.col(c).alias(c + "x") for c in ("g", "n", "at", "lo", "hi")))
    y = member.select("key", *(F.col(c).alias(c + "y") for c in ("g", "n", "at", "lo", "hi")))
    pairs = (x.join(y, "key").where("nx < ny or nx = ny and gx < gy").where("not (lox = hix and loy = hiy and lox = loy)")
             .where(fits("x", "y")).select("gx", "gy").distinct())
    one = of.select(F.col("g").alias("gx"), F.col("c").alias("a"), F.col("comp").alias("ca"))
    two = of.select(F.col("g").alias("gy"), F.col("c").alias("b"), F.col("comp").alias("cb"))
    wide = spans.where("lo <> hi").select(F.col("g").alias("gx"), F.col("g").alias("gy"))
    rest = (_plausible(sets, pairs, percent).union(wide).join(one, "gx").join(two, "gy").where("ca <> cb")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = connected_components(links.union(_verified(docs, rest, words, percent)))

    final = (classes.join(parts, classes["c"] == parts["id"], "left")
             .select("n", "set1", "set2", "c", F.coalesce("component_id", "c").alias("component_id")))
    return (sets.select("doc_id", "n", "set1", "set2").join(final, ["n", "set1", "set2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("class_id"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))
