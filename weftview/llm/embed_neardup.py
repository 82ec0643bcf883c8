"""Near duplicates of embeddings by Euclidean p-stable hashing with exact cosine checks.

Equal vectors under one label are collapsed to a class first.  A class vector, normalised, gets in
each of TABLES tables a code: PROJECTIONS Gaussian projections, shifted and cut into steps of
WIDTH.  Vectors of equal label, length and code meet in a bucket, where every pair's cosine is
computed in double precision.  At cosine 0.93 (distance 0.374) two vectors share a step with
probability 0.80, a code with 0.17 and none of 40 codes with less than 0.001; closer pairs are
missed far less often, and unrelated ones meet with 0.0005 a table.

A pair that meets in several tables counts in the first.  A bucket sends one row per member: the
number of links and the smallest id that it reaches there; no list of pairs is made.  Buckets over
BLOCK members are dealt to all pairs of blocks of their members, each a separate unit of work.

Vectors that are null, empty, zero or hold null or non-finite components, rows without a label or
vec_id, and vectors of unlike length link with nothing.  Repeated rows are vectors of their own.
Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, saved, small
from .components import connected_components

TABLES = 40
PROJECTIONS = 8
WIDTH = 1.5
BLOCK = 2048
_SEED = 7


def _family(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, dim])
    n = tables * projections
    return rng.standard_normal((dim, n)), rng.random(n), rng.integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1


def bucket_codes(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """32-bit codes of normalised vectors, a column for each table."""
    a, shift, odd = _family(unit.shape[1], tables, projections)
    step = np.floor(unit @ a / width + shift).astype(np.int64).reshape(len(unit), tables, projections)
    h = (step * odd).sum(axis=2)
    return ((h ^ (h >> 29)) * np.int64(0x1B873593CC9E2D51 >> 1) >> 32).astype(np.int32)


def _coded(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(b["vector"]):
            by_size.setdefault(len(v), []).append(i)
        for size, at in by_size.items():
            for k in range(0, len(at), 2000):
                rows = at[k:k + 2000]
                x = np.array([b["vector"][i] for i in rows], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes = bucket_codes(x)
                yield {"c": [b["c"][i] for i in rows], "m": [b["m"][i] for i in rows], "label": [b["label"][i] for i in rows], "dim": [size] * len(rows),
                       "codes": list(codes), "all_codes": [r.tobytes() for r in codes], "unit": [r.tobytes() for r in x]}


def _links(ids: np.ndarray, weight: np.ndarray, block: np.ndarray, table: int, codes: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of one bucket: weight of its links that this table is the first to find,
    and the smallest id it reaches by the bucket's links."""
    n = len(ids)
    ia, ib = [], []
    for a in range(0, n, 1024):
        near = unit[a:a + 1024] @ unit.T >= least
        i, j = np.nonzero(near)
        i += a
        keep = i < j
        if block.min() != block.max():
            keep &= block[i] != block[j]
        ia.append(i[keep])
        ib.append(j[keep])
    ia, ib = np.concatenate(ia), np.concatenate(ib)
    count, root = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, len(ia), 1 << 18):
        i, j = ia[a:a + (1 << 18)], ib[a:a + (1 << 18)]
        first = (codes[i] == codes[j]).argmax(axis=1) == table
        np.add.at(count, i[first], weight[j[first]])
        np.add.at(count, j[first], weight[i[first]])
    while len(ia):
        low = root.copy()
        np.minimum.at(low, ia, root[ib])
        np.minimum.at(low, ib, root[ia])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return count, ids[root]


def _buckets(least: float):
    def each(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[dict]:
            a = 0
            out = {"c": [], "links": [], "root": []}
            while a < len(rows):
                b = a + 1
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                if b - a > 1:
                    part = sorted(rows[a:b], key=lambda r: r[1])
                    codes = np.frombuffer(b"".join(r[4] for r in part), np.int32).reshape(b - a, -1)
                    unit = np.frombuffer(b"".join(r[5] for r in part), np.float64).reshape(b - a, -1)
                    ids = np.array([r[1] for r in part], np.int64)
                    count, root = _links(ids, np.array([r[2] for r in part], np.int64), np.array([r[3] for r in part]), part[0][0][2], codes, unit, least)
                    some = np.flatnonzero((count > 0) | (root != ids))
                    out["c"] += ids[some].tolist()
                    out["links"] += count[some].tolist()
                    out["root"] += root[some].tolist()
                a = b
            if out["c"]:
                yield out

        for b in batches:
            keys = zip(b["label"], b["dim"], b["table"], b["code"], b["bi"], b["bj"], strict=True)
            for key, *rest in zip(keys, b["c"], b["m"], b["block"], b["all_codes"], b["unit"], strict=True):
                if len(held) >= BLOCK and held[-1][0] != key:
                    yield from done(held)
                    held = []
                held.append((key, *rest))
        yield from done(held)

    return each


def near_duplicates(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    valid = vectors.where(ok)
    classes = saved(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("c"), F.count("*").alias("m")))
    coded = saved(map_columns(classes.select("c", "m", "label", F.col("embedding").alias("vector")), _coded,
                              "c long, m long, label string, dim int, codes array<int>, all_codes binary, unit binary"))
    key = ["label", "dim", "table", "code"]
    full = (coded.select("label", "dim", F.posexplode("codes").alias("table", "code")).groupBy(*key).count()
            .where(F.col("count") > block).withColumn("parts", F.ceil(F.col("count") / block)).drop("count"))
    rows = coded.select("label", "dim", F.posexplode("codes").alias("table", "code"), "c", "m", "all_codes", "unit").join(small(saved(full)), key, "left")
    parts = F.coalesce("parts", F.lit(1))
    rows = (rows.withColumn("block", F.pmod(F.xxhash64("c"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}))
    unit = [*key, "bi", "bj"]
    dealt = rows.select(*unit, "c", "m", "block", "all_codes", "unit").repartition(*unit).sortWithinPartitions(*unit)
    found = saved(map_columns(dealt, _buckets(least), "c long, links long, root long"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    of = (classes.select("label", "embedding", "c", "m").join(links, "c", "left")
          .join(parts.withColumnRenamed("id", "c"), "c", "left")
          .select("label", "embedding", F.col("m").alias("same"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "c").alias("component")))
    out = vectors.withColumn("ok", ok).join(of.withColumn("ok", F.lit(True)), ["label", "embedding", "ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("same") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
