"""Conversation structure repair by weighted interval parsing.

A repaired conversation has role initials `(s?(ua)+)?`: an optional system row, then user and
assistant in turn.  Its edits are Keep (0), Rerole to user or assistant (REROLE), Delete (DELETE) and
Insert of an empty user or assistant row anywhere (INSERT); a row that is cut short and not deleted
costs CUT more; blank and repeated rows must be deleted.  The cheapest edits are wanted, and among
them those whose initials in order are the least as ASCII.

Grammar, in Chomsky normal form: N(p,q) derives the rows that lead from role state p to q, so
`N(p,q) -> N(p,r) N(r,q) | row`.  A *cell* holds the least (cost, audit) of every N(p,q) over a span.
Cells of single rows come from the edits, each cell is closed under insertion before and behind it,
and cells are combined bottom-up by span length.  A nonterminal says all that its two sides must
know of each other, so each way to split a span gives the same cell: one split a span is enough, and
a conversation costs its rows and not their cube.  (Two audits of one span and cost are never
prefixes of each other - the longer would only have more insertions, and cost more - so the least
audits of two spans make the least of both together.)

On Spark: equal rows are counted first; a row's first like is found by an aggregate; the ordered
rows are cut into ranges, and a task makes one summary (counts, ends, cells) of each conversation in
its range.  Summaries of one conversation, one a range at most, are combined in order.  A conversation
with a third of all rows is thus read by a third of the tasks.  Only `repaired` brings a
conversation's rows to one task, in order and a batch at a time, since its hash is sequential; what
is held of it is its audit.

Nulls in role and text count as one space; a null conv_id is a conversation; null turns come first.
Rows of one turn go by role, then by the SHA-256 of their text, so that equal rows stand together.  A
role that does not start with s, u or a can't be kept.  Empty tables give no rows; other columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # states: start, behind s, behind u, behind a
SPANS = [(p, q) for p in range(4) for q in range(4) if p == q or q > p or (p, q) == (3, 2)]
AT = {s: i for i, s in enumerate(SPANS)}
RULES = [[(AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT] for p, q in SPANS]
INITIALS = "suax"
KINDS = ("suax", "SUAX", "0123")  # by initial: whole, cut short, must be deleted
LEGAL = {"su", "ua", "au"}
KNOWN = 16  # spans up to this length are remembered

Cell = tuple  # of (cost, audit) or None, one for each of SPANS


def join_cells(a: Cell, b: Cell) -> Cell:
    return tuple(min(((a[i][0] + b[j][0], a[i][1] + b[j][1]) for i, j in rule if a[i] and b[j]), default=None) for rule in RULES)


def _insertions() -> Cell:
    one = [(0, "") if p == q else (INSERT, "I") if q in (STEP.get((p, "u")), STEP.get((p, "a"))) else None for p, q in SPANS]
    return join_cells(tuple(one), tuple(one))  # two in a row reach every state that insertions reach


NOTHING = _insertions()


def closed(x: Cell) -> Cell:
    return join_cells(join_cells(NOTHING, x), NOTHING)


def _row_cell(code: str) -> Cell:
    kind = next(k for k, codes in enumerate(KINDS) if code in codes)
    best: dict = {(p, p): (DELETE, "D") for p in range(4)}
    if kind < 2:
        for (p, role), q in STEP.items():
            edits = [(REROLE + CUT * kind, "R")] if role in "ua" else []
            if role == INITIALS[KINDS[kind].index(code)]:
                edits.append((CUT * kind, "K"))
            best[p, q] = min([*edits, *([best[p, q]] if (p, q) in best else [])], default=None)
    return closed(tuple(best.get(s) for s in SPANS))


ROWS = {c: _row_cell(c) for codes in KINDS for c in codes}


def span_cell(codes: str) -> Cell:
    """The cell of a span of rows, spans combined by length: 1, 2, 4, ..."""
    if len(codes) < 2:
        return ROWS[codes] if codes else NOTHING
    return _known(codes) if len(codes) <= KNOWN else _split(codes)


def _split(codes: str) -> Cell:
    half = 1 << ((len(codes) - 1).bit_length() - 1)
    return join_cells(span_cell(codes[:half]), span_cell(codes[half:]))


_known = lru_cache(maxsize=1 << 16)(_split)


def best_audit(cell: Cell) -> tuple[int, str]:
    return min(x for x in (cell[AT[0, 0]], cell[AT[0, 3]]) if x)


# --- rows -----------------------------------------------------------------------

ORDER = ["conv_id", "turn", "role", "digest"]


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) without nulls in role and text."""
    x = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return x.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _code(kind: Column) -> Column:
    """The row's code from its role's initial and kind (0 whole, 1 cut short, 2 must go)."""
    at = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(4)
    return F.substring(F.lit("".join(KINDS)), kind * 4 + at, F.lit(1))


def coded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, code, more, blank): equal rows of a turn in one row, the first
    with its code and `more` that follow it."""
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    x = _rows(conversations).withColumn("end", end).withColumn("conv", F.struct("conv_id"))
    x = saved(x.groupBy("conv", "turn", "role", "digest", "end").agg((F.count("*") - 1).alias("more")))
    first = x.where("end <> ''").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("seen"))
    x = x.join(first, ["conv", "role", "digest"], "left")
    blank = F.col("end") == ""
    kind = F.when(blank | (F.col("seen.turn") < F.col("turn")) | (F.col("seen.turn").isNull() & F.col("turn").isNotNull()), 2).when(F.col("end").isin(".", "!", "?"), 0).otherwise(1)
    return x.select("conv.conv_id", "turn", "role", "digest", _code(kind).alias("code"), "more", blank.alias("blank"))


# --- summaries of spans ------------------------------------------------------------

_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_FIELDS = [("conv_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.int64()) for c in _COUNTS),
           ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
SUMMARY = pa.schema(_FIELDS)
_DDL = "conv_id long, low long, high long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first string, last string, costs array<long>, audits array<string>"


def _plain(code: str) -> str:
    return INITIALS[next(c.index(code) for c in KINDS if code in c)]


_FLAT = str.maketrans({c: _plain(c) for codes in KINDS for c in codes})


class _Span:
    """A run of a conversation's rows as far as it has come."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high, self.first, self.last = conv_id, None, None, "", ""
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.codes, self.cell = [], NOTHING

    def row(self, turn, code, more, blank):
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        gone = code in KINDS[2]
        self.blank += blank * (1 + more)
        self.duplicate += (not blank) * (gone + more)
        self.truncated += code in KINDS[1]
        self.codes.append(code + KINDS[2][INITIALS.index(_plain(code))] * more)
        if len(self.codes) >= 1024:
            self.settle()

    def settle(self):
        codes = "".join(self.codes)
        if codes:
            flat = self.last + codes.translate(_FLAT)
            self.illegal += sum(flat[i:i + 2] not in LEGAL for i in range(len(flat) - 1))
            self.first, self.last, self.rows = self.first or flat[0], flat[-1], self.rows + len(codes)
            self.cell = join_cells(self.cell, span_cell(codes))
        self.codes = []

    def add(self, r: dict):
        """What follows, as a summary."""
        self.illegal += r["illegal"] + bool(self.rows and self.last + r["first"] not in LEGAL)
        self.turns += r["turns"] - (r["low"] is not None and r["low"] == self.high)
        self.low = r["low"] if self.low is None else self.low
        self.high = self.high if r["high"] is None else r["high"]
        for c in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + r[c])
        self.first, self.last = self.first or r["first"], r["last"]
        self.cell = join_cells(self.cell, tuple((c, a) if c is not None else None for c, a in zip(r["costs"], r["audits"], strict=True)))

    def summary(self) -> dict:
        self.settle()
        out = {f.name: getattr(self, f.name) for f in SUMMARY if f.name not in ("costs", "audits")}
        return out | {"costs": [x and x[0] for x in self.cell], "audits": [x and x[1] for x in self.cell]}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span, done = None, []
    for b in batches:
        for conv_id, turn, code, more, blank in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "code", "more", "blank")), strict=True):
            if span is None or span.conv_id != conv_id:
                if span is not None:
                    done.append(span.summary())
                span = _Span(conv_id)
            span.row(turn, code, more, blank)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=SUMMARY)
            done = []
    if span is not None:
        yield pa.RecordBatch.from_pylist([span.summary()], schema=SUMMARY)


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(b.num_rows):
            parts = b.column("parts").slice(i, 1).to_pylist()[0]
            span = _Span(parts[0]["conv_id"])
            for p in parts:
                span.add(p)
            cost, audit = best_audit(span.cell)
            gaps = 0 if span.low is None else span.high - span.low + 1 - span.turns
            out.append({"conv_id": span.conv_id, "gaps": gaps, "blank": span.blank, "duplicate": span.duplicate, "truncated": span.truncated,
                        "illegal": span.illegal, "cost": cost, "audit": audit})
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def audits(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    `conversations`: conv_id, turn, role, text.  `ranges`: into how many the ordered rows are cut."""
    spark = conversations.sparkSession
    n = ranges or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    x = coded(conversations).repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    x = x.select("conv_id", "turn", "code", "more", "blank").mapInArrow(_summaries, _DDL)
    parts = x.withColumn("cut", F.spark_partition_id()).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("cut", *[f.name for f in SUMMARY]))).alias("parts"))
    return parts.select("parts").mapInArrow(_results, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# --- repaired rows -------------------------------------------------------------------

_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("sha256", pa.string())])


class _Repair:
    """Applies one conversation's audit to its rows as they come."""

    def __init__(self, conv_id, audit):
        self.conv_id, self.audit, self.at, self.state, self.hash, self.out = conv_id, audit, 0, 0, hashlib.sha256(), 0

    def put(self, edit, role, text) -> dict:
        if role is None:
            role = "assistant" if self.state == 2 else "user"
        self.state = STEP[self.state, role[0]]
        self.hash.update((("\n" if self.out else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.out += 1
        return {"conv_id": self.conv_id, "place": self.out - 1, "edit": edit, "role": role, "text": text, "sha256": None}

    def inserted(self) -> Iterator[dict]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self.put("I", None, "")

    def row(self, role, text) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.put(edit, role if edit == "K" else None, text)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair, held = None, []

    def ended() -> Iterator[dict]:
        held.extend(repair.inserted())
        if held:
            held[-1]["sha256"] = repair.hash.hexdigest()
        yield from held
        held.clear()

    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            out = []
            for conv_id, audit, role, text in zip(*(batch.slice(k, 1000).column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if audit is not None:
                    if repair is not None:
                        out += ended()
                    repair = _Repair(conv_id, audit)
                else:
                    new = list(repair.row(role, text))
                    if new:  # the last row is held back: it gets the hash
                        out += held
                        held[:] = new
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_REPAIRED)
    if repair is not None:
        yield pa.RecordBatch.from_pylist(list(ended()), schema=_REPAIRED)


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text, sha256): the rows of each repaired conversation in order.

    `found`: conv_id and audit, as `audits` gives them.  `sha256` stands in a conversation's last row:
    of its `role:text` lines joined by newlines.  A conversation that lost all rows has none here."""
    rows = _rows(conversations).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv_id", "audit").withColumn("head", F.lit(0))
    x = rows.withColumn("head", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    x = x.repartition("conv_id").sortWithinPartitions("conv_id", "head", *ORDER[1:])
    return x.select("conv_id", "audit", "role", "text").mapInArrow(_repairs, "conv_id long, place long, edit string, role string, text string, sha256 string")


# --- damage --------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's crc32(`conv_id:turn`) modulo 20 names:
    0 drops it, 1 empties its text, 2 takes `[.!?]` out, 3 repeats it, 4 makes its role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    x = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                             (F.crc32(key.cast("binary")) % 20).alias("hurt")).where("hurt <> 0")
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("hurt") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
