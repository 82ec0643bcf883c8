"""Connected components of a link table: contraction within tasks, then star rounds between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, saved

#: Links that one task contracts at a time.
BLOCK = 500_000


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of u to the smallest vertex of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join u and its smaller neighbours to the smallest of them (edges run from u down to v)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _contracted(batches: Iterator[dict]) -> Iterator[dict]:
    """A task's links as a star around each smallest vertex that they reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for u, v in zip(b["u"], b["v"], strict=True):
            u, v = find(u) if u in root else root.setdefault(u, u), find(v) if v in root else root.setdefault(v, v)
            if u != v:
                root[max(u, v)] = min(u, v)
    pairs = [(x, find(x)) for x in root]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield {"u": [p[0] for p in pairs], "v": [p[1] for p in pairs]}


def connected_components(links: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """Rows (id, component_id) for each id of `links` that is not its component's smallest id.

    Ids in no link, and each component's smallest id, have no row: callers coalesce to the id.
    Loops, doubled and reversed links and null ends are allowed and change nothing.  Links are dealt
    to tasks of about `block` each and contracted there, so that memory is bounded; where there are
    several tasks, star rounds join their results.  A round aggregates with map-side combine and
    joins on the vertex (Spark splits a hub's rows); it is written to the shared folder, so that
    the plan doesn't grow with the rounds."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = saved(links.where(x.isNotNull() & y.isNotNull() & (x != y))
                  .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")))
    tasks = max(1, math.ceil(edges.count() / block))
    edges = saved(map_columns(edges.repartition(tasks), _contracted, "u long, v long"))
    if tasks > 1:
        edges = saved(edges.distinct())
        before = _signature(edges)
        while before[0]:
            edges = saved(_small_star(_large_star(edges).distinct()).distinct())
            now = _signature(edges)
            if now == before:
                break
            before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
