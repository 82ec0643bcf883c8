"""Table rows (C11, rules of SURVEY N4).

A row is the `` | ``-joined list of its cells' items, kept when longer than 10
characters.  A cell that contains links contributes only its links (text
longer than 3 characters; ``[text](href)`` when href is set and not ``#...``,
else the bare text); a cell without links contributes its stripped text when
longer than 2 characters.

A cell or row holds whatever is inside it at any depth, so the cells of a nested
table count for the rows around it as well, and their links and text for the cells
around them.

The tokens of a page are one list (an aggregation on the ``page_id`` partitioning).  One
pass over it, in Python, keeps the open rows, cells and links as chains and adds each
text to the links and cells around it: no window, no join, and no row for each level a
token is nested at.  What a token costs is its depth.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tokens import attr_value, tokenize

# --- fixed values: the cell / row rules -----------------------------------------
LINK_MIN = 3   # link text must be longer than this
CELL_MIN = 2   # cell text must be longer than this
ROW_MIN = 10   # row text must be longer than this
ROW_SEP = " | "

_GROUPS = {"table": ("table",), "row": ("tr",), "cell": ("td", "th"), "link": ("a",)}
_TEXT = 0
_TABLE, _ROW, _CELL, _LINK = range(1, len(_GROUPS) + 1)  # a start tag; an end tag is the negative of it

#: The chain ``(start, chain of what is around)`` of open elements of a group, innermost first; None: none.
Chain = tuple[int, "Chain"] | None
#: A token that carries something: pos, code, text or href, and the links, cells and rows around it.
Token = tuple[int, int, str | None, Chain, Chain, Chain]


def _code() -> Column:
    """What a token is to a table: text, start or end of an element of a group, else NULL."""
    code = F.when(F.col("kind") == "text", _TEXT)
    for k, names in enumerate(_GROUPS.values(), 1):
        code = code.when(F.col("tag").isin(*names) & (F.col("sign") != 0), F.col("sign") * k)
    return code.cast("byte")


def enclosing(tokens: Iterable[tuple[int, int, str | None]]) -> Iterator[Token]:
    """A page's ``(pos, code, text or href)`` in order -> its texts and starts of rows, cells and links that
    are in a row, with the starts of what is around them (of tables' elements only); a start tag is inside its
    own element.  Stray end tags count for nothing.

    Around a token is, at each level it is nested at, the last element opened there.
    """
    tables, rows, cells, links = opened = [[None], [None], [None], [None]]  # what is around at each level so far
    by_code = [[], *opened, *opened[::-1]]  # by a code of either sign
    last: list[list[int]] = [[-1] for _ in by_code]  # by code and level: the start last opened there, -1: not a table's
    for pos, code, s in tokens:
        if code:
            around = by_code[code]
            if code < 0:
                if len(around) > 1:
                    around.pop()
                continue
            level, starts = len(around), last[code]
            if level == len(starts):
                starts.append(-1)
            if code == _ROW or len(rows) > 1:
                starts[level] = pos if len(tables) > 1 else -1
            k = starts[level]
            around.append(around[-1] if k < 0 else (k, around[-1]))
            if code == _TABLE:
                continue
        if len(rows) > 1:
            yield pos, code, s, links[-1], cells[-1], rows[-1]


def _merged(tokens: Iterable[Token]) -> Iterator[Token]:
    """Tokens of pages with one ``page_id``: those of a place are one, the first that is in a cell, else in a
    link, else in a row, with all that is around any of them."""
    def walk(chains: Iterable[Chain]) -> Iterator[int]:
        for c in chains:
            while c:
                k, c = c
                yield k

    for pos, same in groupby((t for t in tokens if t[3] or t[4] or t[5]), lambda t: t[0]):
        same = list(same)
        around: list[Chain] = [None] * 3
        for i in range(3):
            for k in sorted(walk(t[3 + i] for t in same)):
                around[i] = (k, around[i])
        first = min(same, key=lambda t: 0 if t[4] else 1 if t[3] else 2)
        yield pos, *first[1:3], *around


def _rows(tokens: Iterable[Token]) -> Iterator[tuple[int, str]]:
    """``(row_pos, text)`` of a page's kept rows."""
    links: dict[int, tuple] = {}  # by start: texts, href, cells and rows around
    cells: dict[int, tuple] = {}  # by start: texts, rows around
    linked = set()  # cells with a link
    for pos, code, s, in_links, in_cells, in_rows in tokens:
        if in_links and in_links[0] == pos:
            links[pos] = [], s if code == _LINK else None, in_cells, in_rows
        if in_cells and in_cells[0] == pos:
            cells[pos] = [], in_rows
        if code == _TEXT:
            while in_links:
                k, in_links = in_links
                links[k][0].append(s)
            while in_cells:
                k, in_cells = in_cells
                cells[k][0].append(s)
        elif code == _LINK:
            while in_cells:
                k, in_cells = in_cells
                linked.add(k)
    found: dict[int, list[tuple[int, int, str]]] = {}  # by row: cell, item's start, item

    def put(item: str, start: int, cell: int, rows: Chain) -> None:
        while rows:
            row, rows = rows
            if row < cell:
                found.setdefault(row, []).append((cell, start, item))

    for start, (texts, rows) in cells.items():
        if start not in linked:
            text = "".join(texts).strip()
            if len(text) > CELL_MIN:
                put(text, start, start, rows)
    for start, (texts, href, around, rows) in links.items():
        text = "".join(texts).strip()
        if len(text) > LINK_MIN:
            item = f"[{text}]({href})" if href and not href.startswith("#") else text
            while around:
                cell, around = around
                put(item, start, cell, rows)
    for row, items in found.items():
        items.sort()
        text = ROW_SEP.join([x[2] for x in items])
        if len(text) > ROW_MIN:
            yield row, text


def _page_rows(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(page_id, tokens)`` -> ``(page_id, row_pos, text)``."""
    for batch in pages:
        lists = batch.column("tokens")
        starts = lists.offsets.to_numpy()
        of = lists.values
        pos, code = of.field("pos").to_numpy(), of.field("code").to_numpy()
        s = of.field("s").to_numpy(zero_copy_only=False).tolist()
        back = np.flatnonzero(pos[1:] <= pos[:-1]) + 1  # a page's tokens are not in order, or a page_id is repeated
        odd = set((np.searchsorted(starts, back[~np.isin(back, starts)], "right") - 1).tolist())
        pos, code, starts = pos.tolist(), code.tolist(), starts.tolist()
        of_page, row_pos, texts = [], [], []
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            tokens = zip(pos[a:b], code[a:b], s[a:b])
            if k in odd:
                found = _rows(_merged(enclosing(sorted(tokens, key=lambda t: t[0]))))
            else:
                found = _rows(enclosing(tokens))
            for row, text in found:
                of_page.append(k)
                row_pos.append(row)
                texts.append(text)
        ids = batch.column("page_id").take(pa.array(of_page, pa.int32()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(row_pos, pa.int64()), pa.array(texts, pa.string())], ["page_id", "row_pos", "text"])


def table_rows(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> ``(page_id, row_pos, text)`` for every kept row.

    Null and empty pages, and pages without a table, give no rows.
    """
    t = tokenize(pages.select("page_id", "html"))
    s = F.when(F.col("kind") == "text", F.col("text")).when(F.col("tag") == "a", attr_value("attrs", "href"))
    token = F.struct("pos", _code().alias("code"), s.alias("s"))
    t = t.select("page_id", F.when(token["code"].isNotNull(), token).alias("token"))
    x = t.groupBy("page_id").agg(F.collect_list("token").alias("tokens"))
    schema = StructType([pages.schema["page_id"], StructField("row_pos", LongType()), StructField("text", StringType())])
    return x.mapInArrow(_page_rows, schema)
