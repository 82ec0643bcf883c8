"""Navigation history per session (H1, H2, K4, K6).

``nav_events`` rows: ``session_id, ts, seq, op ('visit'|'back'), url, ok``;
order within a session is ``(ts, seq)``.

History semantics: a visit appends its URL unless it equals the current last
entry; the history keeps the last ``cap`` (50) entries; ``back`` needs at least
two entries and drops the last one (it pops the current and the previous entry
and revisits the previous, which re-appends it).

**Histories in parallel.**  A session's events are cut into buckets (ranges of the
order), and a task folds a bucket without knowing the history it starts from.
What it does to *any* history is a short list of steps (``_Run``):

* ``B``: a back that reaches below the bucket's own visits.
* ``M url h``: a visit whose page was left again by a back.  It changes nothing,
  unless ``url`` is what the history ends with: then the visit added nothing, and
  the back took that entry.  Up to ``h`` entries stood above the history meanwhile,
  which may have pushed its oldest ones out.
* ``T url h``: as ``M``, for visits that were not left again: only the pushing out.
* ``R``: the bucket's own visits filled the history; nothing earlier matters.
* ``V url``: a visit that still stands at the bucket's end (at most ``cap``).

Steps that can't matter are left out, so a bucket gives few.  Playing a
session's steps in the order of its buckets gives the history each bucket starts
from, and the last one (K4).  From there a bucket's events can be folded again, now
exactly, to tell what each *back* shows (K6).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.patterns import HISTORY_CAP
from ..session import written
from .sequence import default_buckets, last_value_before, range_buckets, top_k_last

ORDER = ["ts", "seq"]
KEYS = ["session_id"]


def visits_deduped(ev: DataFrame, buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """H1: visits whose URL differs from the visit right before (non-adjacent repeats stay).

    ``keep_bucket`` keeps the range bucket ``_b`` for a following ordered step.
    """
    v = range_buckets(ev.where(F.col("op") == "visit"), KEYS, ORDER, buckets)
    v = last_value_before(v, KEYS, "_b", ORDER, "url", "prev_url", inclusive=False)
    v = v.where(~F.col("url").eqNullSafe(F.col("prev_url")))
    return v if keep_bucket else v.drop("_b")


def last_n(visits: DataFrame, n: int = HISTORY_CAP, buckets: int | None = None) -> DataFrame:
    """H2: the last ``n`` entries per session, ``from_end`` 1 = newest.

    Reuses an existing ``_b`` bucket column (from ``visits_deduped``) when present.
    """
    v = visits if "_b" in visits.columns else range_buckets(visits, KEYS, ORDER, buckets)
    return top_k_last(v, KEYS, "_b", ORDER, n).drop("_b")


HISTORY_SCHEMA = "session_id long, pos long, url string"


def visited(stack: list, url, cap: int) -> None:
    """A visit's change to the history."""
    if not stack or stack[-1] != url:
        stack.append(url)
        del stack[:-cap]


def left(stack: list) -> bool:
    """A back's change to the history; whether there was one."""
    if len(stack) < 2:
        return False
    stack.pop()
    return True


class _Run:
    """A run of events folded over an unknown history.

    ``own`` holds the run's own visits that still stand, ``high`` the most there were
    since it was last empty.  Of the steps found, those that can't matter are left out.  With
    ``top`` the highest ``h`` so far, a history has at most ``cap - top`` entries left, so a
    lower ``h`` pushes nothing out (it is written as 0).  ``M url`` pops only if another pop came
    after the last ``M url`` (a history has no equal neighbours), so the fewest pops that one
    needs are counted; beyond ``cap - 1`` pops a history has one entry, which nothing removes.
    The first ``M`` stays: below a session's first visit there is no history.
    """

    def __init__(self, cap: int):
        self.cap, self.own, self.high, self.known = cap, [], 0, False
        self.rows, self.backs, self.top, self.matched = [], 0, 0, False
        self.n, self.last = 0, {}  # B and M so far; url -> number of its last M
        self.at, self.need = [], []  # numbers of possible pops, and their needs where no later one needs less

    def event(self, op: str, url) -> None:
        if op != "back":
            visited(self.own, url, self.cap)
            if not self.known:
                self.high = max(self.high, len(self.own))
                self.known = len(self.own) == self.cap
        elif self.known:
            left(self.own)
        elif not self.own:
            self._back()
        else:
            gone = self.own.pop()
            if not self.own:
                self._match(gone)
                self.high = 0

    def _pop(self, need: int) -> None:
        while self.need and self.need[-1] >= need:
            self.need.pop()
            self.at.pop()
        self.at.append(self.n)
        self.need.append(need)

    def _back(self) -> None:
        self.n += 1
        self.backs += 1
        if self.backs < self.cap:
            self._pop(self.backs)
            self.rows.append(("B", None, 0))

    def _match(self, url) -> None:
        self.n += 1
        need = 1 + self.backs
        if url in self.last:
            k = bisect_right(self.at, self.last[url])
            need = max(need, 1 + self.need[k]) if k < len(self.need) else self.cap
        self.last[url] = self.n
        if need < self.cap:
            self._pop(need)
        if need < self.cap or self.high > self.top or not self.matched:
            self.rows.append(("M", url, self.high if self.high > self.top else 0))
        self.top, self.matched = max(self.top, self.high), True

    def steps(self) -> list[tuple]:
        """(step, url, h) in order, at least one."""
        rows = [("R", None, 0)] if self.known else list(self.rows)
        if not self.known and self.own and self.high > max(self.top, len(self.own)):
            rows.append(("T", self.own[0], self.high))
        return [*rows, *(("V", url, 0) for url in self.own)] or [("B", None, 0)]


def play(stack: list, step: str, url, h: int, cap: int) -> None:
    """One step's change to the history."""
    if step == "V":
        visited(stack, url, cap)
    elif step == "B":
        left(stack)
    elif step == "R":
        stack.clear()
    elif not stack:
        if step == "M":
            stack.append(url)  # nothing below it: the back that should leave it does nothing
    else:
        same = stack[-1] == url
        del stack[:-(cap - h + same)]
        if same and step == "M":
            left(stack)


def _rows(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in cols), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


STEP_SCHEMA = "session_id long, bucket long, k long, step string, url string, h long"
_STEPS = pa.schema([("session_id", pa.int64()), ("bucket", pa.int64()), ("k", pa.int64()), ("step", pa.string()), ("url", pa.string()), ("h", pa.int64())])
PLAYED_SCHEMA = "session_id long, bucket long, before array<string>, final array<string>"
_PLAYED = pa.schema([("session_id", pa.int64()), ("bucket", pa.int64()), ("before", pa.list_(pa.string())), ("final", pa.list_(pa.string()))])


def _summarised(cap: int):
    """Rows in the order of (session, bucket, order) -> steps of each (session, bucket)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, run = None, None
        for session, bucket, op, url in _rows(batches, "session_id", "bucket", "op", "url"):
            if key != (session, bucket):
                if run is not None:
                    yield from ((*key, k, *step) for k, step in enumerate(run.steps()))
                key, run = (session, bucket), _Run(cap)
            run.event(op, url)
        if run is not None:
            yield from ((*key, k, *step) for k, step in enumerate(run.steps()))

    return lambda batches: _batches(rows(batches), _STEPS)


def _played(cap: int):
    """Steps in order -> the history before each (session, bucket), and a session's last one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, before, stack = None, [], []
        for session, bucket, step, url, h in _rows(batches, "session_id", "bucket", "step", "url", "h"):
            if key != (session, bucket):
                if key is not None:
                    yield *key, before, None if key[0] == session else stack
                stack = stack if key is not None and key[0] == session else []
                key, before = (session, bucket), list(stack)
            play(stack, step, url, h, cap)
        if key is not None:
            yield *key, before, stack

    return lambda batches: _batches(rows(batches), _PLAYED)


def bucket_steps(rows: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The steps of each (session, bucket).  ``rows`` come in order in their partitions, a (session,
    bucket) in one of them."""
    x = written(rows.select("session_id", "bucket", "op", "url").mapInArrow(_summarised(cap), STEP_SCHEMA))
    # a visit left again matters only if its URL stands in some history: at the end of some bucket
    ends = x.where("step = 'V'").select("session_id", F.col("url").alias("end_url")).distinct()
    idle = (F.col("step") == "M") & (F.col("h") == 0) & (F.col("k") > 0)
    m = x.where(idle).join(ends, F.col("url").eqNullSafe(F.col("end_url")) & x["session_id"].eqNullSafe(ends["session_id"]), "left_semi")
    return x.where(~idle).unionByName(m)


def played(steps: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """``session_id, bucket, before, final``: the history each bucket starts from; ``final`` is the
    session's history, in the row of its last bucket."""
    x = steps.repartition("session_id").sortWithinPartitions("session_id", "bucket", "k")
    return x.mapInArrow(_played(cap), PLAYED_SCHEMA)


def history(ev: DataFrame, cap: int = HISTORY_CAP, buckets: int | None = None) -> DataFrame:
    """K4: final history per session as rows ``(session_id, pos, url)``, pos 0 = oldest.

    The events move once, into ranges of the order, each folded by one task; a session with
    a third of all events is folded by a third of the tasks.  Its steps (module docstring) meet
    in one task, in order and a batch at a time.  Sessions without a visit give no rows.
    """
    n = buckets or default_buckets(ev)
    x = (ev.select("session_id", "ts", "seq", "op", "url").repartitionByRange(n, "session_id", "ts", "seq")
         .sortWithinPartitions("session_id", "ts", "seq").withColumn("bucket", F.spark_partition_id().cast("long")))
    last = played(bucket_steps(x, cap), cap).where("final is not null")
    return last.select("session_id", F.posexplode("final").alias("pos", "url")).withColumn("pos", F.col("pos").cast("long"))


def _shown(cap: int):
    """Adds what each event shows to a bucket's rows in order; the rows with ``before`` start a bucket and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = []
        for b in batches:
            shown, keep = [], []
            for first, before, op, url, ok in _rows([b], "first", "before", "op", "url", "ok"):
                if first:
                    stack, show = list(before), None
                elif op == "back":
                    show = stack[-1] if left(stack) and ok else None
                else:
                    visited(stack, url, cap)
                    show = url if ok else None
                keep.append(not first)
                if not first:
                    shown.append(show)
            out = b.drop_columns(["first", "before"]).filter(pa.array(keep, pa.bool_()))
            yield out.append_column("shown", pa.array(shown, pa.string()))

    return run


def current_page(ev: DataFrame, buckets: int | None = None, cap: int = HISTORY_CAP) -> DataFrame:
    """K6: after each event, the page shown: that of the last visit that loaded, or the one that the
    last *back* that loaded returned to (NULL before any).

    A back with fewer than two entries, and a page that fails to load (``ok`` false or NULL) or has
    no URL, leave the page as it was; a failed visit is in the history all the same.
    """
    x = range_buckets(ev, KEYS, ORDER, buckets, out="bucket")
    by = ["session_id", "bucket"]
    inside = x.repartition(*by).sortWithinPartitions(*by, *ORDER)
    heads = played(bucket_steps(inside, cap), cap).select(*by, "before", F.lit(True).alias("first"))
    x = x.withColumn("first", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    x = x.repartition(*by).sortWithinPartitions(*by, F.col("first").desc(), *ORDER)
    kept = StructType([f for f in x.schema.fields if f.name not in ("first", "before")] + [StructField("shown", StringType())])
    x = written(x.mapInArrow(_shown(cap), kept))
    return last_value_before(x, KEYS, "bucket", ORDER, "shown", "current_url", inclusive=True).drop("shown", "bucket")
