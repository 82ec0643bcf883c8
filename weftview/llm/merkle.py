"""Merkle dataset manifest: a content-addressed DAG and proofs by descent.

Every row is a leaf.  The leaves of a language, in the order of their ids, are the bottom of a tree
of FANOUT children a node; the tops of these trees (subroots), in the order of their languages, are
the bottom of one more tree, whose top is the root.  A digest H is the SHA-256 of its inputs joined;
digests go in as lowercase hex text.

1. *Leaves.*  `leaf_rows` hashes each row where it is read: from here on rows are narrow.
2. *Ranks.*  `ranked` cuts the ordered rows into ranges, counts the ranges and numbers the rows in
   each: no key is numbered in one task, however many rows it has.
3. *Store.*  `build` turns each run of FANOUT nodes into a record (digest, children), level by level,
   an eighth as many rows each time.  A record is found by its digest alone; equal runs are one.
4. *Descent.*  `descend` starts with the root and looks records up by digest.  A node goes to its
   children, each with what its rank digit leaves unselected as one more path segment.  Requests
   that share a path share its rows: a level costs its nodes, not its requests.  At the leaves the
   segments, gathered from the root down, are reversed: a proof reads from the leaf up.

Levels are shuffled by digest; equal runs (repeated rows) are the only digests that may be frequent,
and a lookup is a plain join that Spark splits.  Broadcast is left to Spark.  What comes to the
driver is the number of nodes of the largest language.

Nulls hash as `-`; a null language is a language of its own and the first.  Rows without an id come
first in their language; rows with one id go by their leaf digests, and rows that are equal as
wholes are interchangeable.  An empty text is `0:`.  A table without rows has no root and gives no
rows.  Columns other than the named five are never read, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftview.operators.sequence import range_buckets

from .common import saved

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENTS = "array<struct<left: binary, right: binary>>"


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _joined(digests: Column) -> Column:
    """An array of digests as one binary value."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def encoded(value: Column) -> Column:
    """`-` for null, else the number of bytes of the value as text, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def leaf_rows(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(part, doc_id, leaf, current): a row's digest, and its digest with `now` as its text if that differs.

    `part` orders languages with null first: it is empty for null."""
    now = F.col("text") if now is None else now
    rest = [F.col(c) for c in FIELDS[:-1]]
    x = docs.select(*FIELDS, now.alias("now_text"))
    changed = ~F.col("now_text").eqNullSafe(F.col("text"))
    return x.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("part"), "doc_id",
                    leaf_digest(*rest, F.col("text")).alias("leaf"),
                    F.when(changed, leaf_digest(*rest, F.col("now_text"))).alias("current"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `idx`, the place from 0 in the order within `part`, and `n`, the rows of the part."""
    x = rows.withColumn("spot", F.monotonically_increasing_id())  # parts equal rows, so that ranges stay small
    x = range_buckets(x, ["part"], [*order, "spot"], out="cut")
    before = Window.partitionBy("part").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = x.groupBy("part", "cut").agg(F.count("*").alias("size")).select(
        "part", "cut", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"),
        F.sum("size").over(Window.partitionBy("part")).alias("n"))
    place = F.row_number().over(Window.partitionBy("part", "cut").orderBy(*order, "spot"))
    return x.join(cuts, ["part", "cut"]).withColumn("idx", F.col("first") + place - 1).drop("cut", "spot", "first")


class Tree(NamedTuple):
    """`stores[k - 1]`: the records (digest, children) of level k.  `tops`: (part, digest, height)."""

    stores: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame) -> Tree:
    """The trees over nodes (part, idx, n, digest), idx from 0 to n - 1 in each part."""
    nodes = nodes.select("part", "idx", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    stores, tops = [], nodes.where("n = 1").select("part", "digest", F.lit(0).alias("height"))
    while most > 1:
        most = -(-most // FANOUT)
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        level = (nodes.where("n > 1").groupBy("part", "n", F.expr(f"idx div {FANOUT}").alias("up")).agg(run.alias("run"))
                 .select("part", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
                         F.col("run.digest").alias("children")))
        level = saved(level.withColumn("digest", F.unhex(F.sha2(_hex(_joined(F.col("children"))), 256))))
        stores.append(saved(level.groupBy("digest").agg(F.first("children").alias("children"))))
        nodes = level.select("part", "idx", "n", "digest")
        tops = tops.unionByName(nodes.where("n = 1").select("part", "digest", F.lit(len(stores)).alias("height")))
    return Tree(stores, tops)


def descend(tree: Tree, starts: DataFrame, carry: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """The runs that requests end in: (part, run, children, path, *carry), `path` from the top down.

    `starts`: (part, digest, height, path, *carry), the tops to start from with the path above them.
    `wanted`: (part, idx) of the leaves asked for; None for all.  A top that is itself a leaf is a run
    of one, whose `alone` is true: it has no segment of its own."""
    keep = ["part", "idx", "digest", "path", *carry]
    starts = starts.withColumn("idx", F.lit(0).cast("long"))

    def asked(nodes: DataFrame, level: int) -> DataFrame:
        if wanted is None:
            return nodes
        return nodes.join(wanted.select("part", F.expr(f"idx div {FANOUT ** level}").alias("idx")).distinct(), ["part", "idx"], "left_semi")

    here = None
    for level in range(len(tree.stores), 0, -1):
        new = asked(starts.where(F.col("height") == level).select(*keep), level)
        here = new if here is None else here.unionByName(new)
        here = here.join(tree.stores[level - 1], "digest")
        if level > 1:
            below = here.select("part", F.col("idx").alias("up"), "children", "path", *carry, F.posexplode("children").alias("digit", "digest"))
            here = asked(below.select("part", (F.col("up") * FANOUT + F.col("digit")).alias("idx"), "digest",
                                      with_segment("path", "children", F.col("digit")).alias("path"), *carry), level - 1)
    lone = asked(starts.where("height = 0").select(*keep), 0).withColumn("children", F.array("digest"))
    runs = lone.withColumn("alone", F.lit(True))
    if here is not None:
        runs = runs.unionByName(here.withColumn("alone", F.lit(False)), allowMissingColumns=True)
    return runs.select("part", F.col("idx").alias("run"), "children", "path", "alone", *carry)


def with_segment(path: str, children: str, digit: Column) -> Column:
    """The path with what `digit` leaves unselected of the children."""
    left = F.slice(F.col(children), F.lit(1), digit)
    right = F.slice(F.col(children), digit + 2, F.lit(FANOUT))
    return F.concat(F.col(path), F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"))))


def manifest(leaves: DataFrame) -> tuple[Tree, Tree, DataFrame]:
    """(trees of the parts, tree over their tops, (part, idx, n, digest, height) of the subroots)
    from leaves (part, idx, n, digest)."""
    low = build(leaves)
    tops = saved(ranked(low.tops.select(F.lit("").alias("part"), F.col("part").alias("lang_part"), "digest", "height"), ["lang_part"]))
    return low, build(tops.select("part", "idx", "n", "digest")), tops


def proofs(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, leaf, current, subroot, root, path): each row's digest, the digest of its text as it
    is now if changed, the tops above it, and its path: segments (left, right) from the leaf up to
    the root, each with the siblings on either side.  Digests are binary."""
    leaves = saved(ranked(saved(leaf_rows(docs, now)), ["doc_id", "leaf"]))
    low, high, tops = manifest(leaves.withColumnRenamed("leaf", "digest"))
    none = F.expr(f"cast(array() as {SEGMENTS})")
    root = high.tops.select("part", "digest", "height", F.col("digest").alias("root"), none.alias("path"))
    langs = selected(descend(high, root, ["root"]), tops.select("part", "idx", F.col("lang_part"), F.col("height").alias("low_height")), ["lang_part", "low_height"], ["root"])
    starts = langs.select(F.col("lang_part").alias("part"), "digest", F.col("low_height").alias("height"), F.col("digest").alias("subroot"), "root", "path")
    out = selected(descend(low, starts, ["subroot", "root"]), leaves.select("part", "idx", "doc_id", "current"), ["doc_id", "current"], ["subroot", "root"])
    return out.select("doc_id", F.col("digest").alias("leaf"), "current", "subroot", "root", F.reverse("path").alias("path"))


def selected(runs: DataFrame, requests: DataFrame, wanted: list[str], carry: list[str]) -> DataFrame:
    """Each request (part, idx, *wanted) with the child its last digit selects (`digest`) and its path.

    The requests of a run come as one row, so that a run's path is moved once."""
    asked = requests.groupBy("part", F.expr(f"idx div {FANOUT}").alias("run")).agg(
        F.collect_list(F.struct((F.col("idx") % FANOUT).cast("int").alias("digit"), *wanted)).alias("ask"))
    x = runs.join(asked, ["part", "run"]).select("part", "children", "path", "alone", *carry, F.explode("ask").alias("ask"))
    x = x.select("part", "children", "path", "alone", *carry, "ask.*")
    path = F.when(F.col("alone"), F.col("path")).otherwise(with_segment("path", "children", F.col("digit")))
    return x.select("part", F.element_at("children", F.col("digit") + 1).alias("digest"), path.alias("path"), *wanted, *carry)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (from the leaf up) give."""
    return F.aggregate(path, leaf, lambda a, s: F.unhex(F.sha2(F.concat(_hex(s["left"]), _hex(a), _hex(s["right"])), 256)))


def proof_digest(path: Column) -> Column:
    """H of all siblings in the order of the path."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, _hex(s["left"]), _hex(s["right"]))), 256)


def verified(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """`proofs` with digests as hex text, the path's digest, and whether the leaf as it is now still gives the root."""
    x = proofs(docs, now)
    x = x.withColumn("fold", folded(F.coalesce("current", "leaf"), F.col("path")))
    return x.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
                    proof_digest(F.col("path")).alias("proof_sha256"), _hex(F.col("fold")).alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"))
