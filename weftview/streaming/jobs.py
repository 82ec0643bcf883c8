"""Structured Streaming forms (K1-K5).

* K1/K3 ``stream_page_views``: pages arrive as files; each micro-batch runs the
  batch page pipeline (a page is complete in one row, so a micro-batch is
  exact) through ``foreachBatch`` and writes views and links by epoch.
* K2 ``response_lines_stream``: chunks arrive in order per response; keyed
  state holds the unterminated line; an ``is_last`` chunk flushes it.
* K4 ``history_stream``: navigation events per session; keyed state holds the
  history stack (at most the cap), emitted after every micro-batch.
* K5 ``task_status_stream``: task events per session; keyed state holds the
  last event per view since the last navigate.

Stateful parts use ``applyInPandasWithState``; their state is bounded (one
partial line / one capped stack / one small map per key), never the whole
key's history.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.aggs import ordered_join
from ..functions.patterns import HISTORY_CAP
from ..operators.chunks import LINE_PIECE_RE
from ..operators.content import page_structure, page_title_agg
from ..operators.links import extract_links
from ..operators.markdown import (
    fragment,
    normalize_md,
    raw_header,
    render_context,
    strip_link_target_spaces,
    unwrap_link_targets,
)
from ..operators.tokens import tokenize

PAGE_SCHEMA = "page_id long, url string, html string"
CHUNK_SCHEMA = "conv_id long, seq long, chunk string, is_last boolean"
NAV_SCHEMA = "session_id long, ts timestamp, seq long, op string, url string"


def raw_view_batch(pages: DataFrame) -> DataFrame:
    """The raw view (D1 with header) for a batch of pages: ``page_id, url, markdown``."""
    st = render_context(page_structure(
        tokenize(pages.select("page_id", "url", "html"), with_url=True)))
    st = st.withColumn("frag", fragment(images=True, raw=True))
    j = st.groupBy("page_id").agg(F.max("url").alias("url"), page_title_agg(whole_page=True).alias("title"),
                                  ordered_join("frag", ["pos"]).alias("md"))
    md = strip_link_target_spaces(unwrap_link_targets(normalize_md(F.coalesce("md", F.lit("")))))
    return j.select("page_id", "url", F.concat(raw_header(F.coalesce("title", F.lit("No Title")),
                                                          F.col("url")),
                                               F.coalesce(md, F.lit("\n"))).alias("markdown"))


def stream_page_views(spark, source_dir: str, sink_dir: str, checkpoint_dir: str | None = None,
                      available_now: bool = True, files_per_batch: int | None = None):
    """K1/K3: raw and clean views and the raw views' links for pages as they arrive (parquet files).

    Each micro-batch overwrites its own ``epoch=<n>`` folder of the ``views`` and
    ``links`` tables, so that a batch that Spark runs again repeats nothing; links
    are taken from the written views.  The query's checkpoint defaults to a folder
    under the session's ``spark.checkpoint.dir`` (the cluster's shared folder).
    """
    from ..plans.batch import page_views

    if checkpoint_dir is None:
        from ..session import checkpoint_dir as shared_dir
        checkpoint_dir = f"{shared_dir(spark).rstrip('/')}/stream-page-views"
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.parquet(source_dir)

    def each(batch: DataFrame, epoch: int) -> None:
        views = f"{sink_dir}/views/epoch={epoch}"
        page_views(batch).write.mode("overwrite").parquet(views)
        raw = batch.sparkSession.read.parquet(views).where("view_id = 'raw'")
        links = extract_links(raw.select("page_id", "url", "content"), ["page_id", "url"], "content")
        links.write.mode("overwrite").parquet(f"{sink_dir}/links/epoch={epoch}")

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


LINE_OUT = "conv_id long, line_no long, line string"
LINE_STATE = "open_line string, line_no long"


def _lines_state(key, pdfs: Iterator[pd.DataFrame], state):
    """Cut what a response has gained into pieces (``LINE_PIECE_RE``, as the batch form does); only
    the last piece can be open, and it waits in the state unless the response has ended."""
    open_line, first = state.get if state.exists else ("", 0)
    new = pd.concat(list(pdfs)).sort_values("seq")
    ended = bool(new["is_last"].any())
    pieces = re.findall(LINE_PIECE_RE, open_line + "".join(new["chunk"].dropna()))
    waits = pieces.pop() if pieces and not ended and not pieces[-1].endswith("\n") else ""
    if ended:
        state.remove()
    else:
        state.update((waits, first + len(pieces)))
    yield pd.DataFrame({"conv_id": pd.Series([key[0]] * len(pieces), dtype="int64"),
                        "line_no": pd.Series(range(first, first + len(pieces)), dtype="int64"), "line": pieces})


def response_lines_stream(chunks: DataFrame) -> DataFrame:
    """K2 on a stream: whole lines as they complete; the remainder on ``is_last``.

    Chunks of one response must arrive in ``seq`` order across micro-batches
    (within a batch they are sorted); state is the open line only, and it is
    gone once the response has ended.
    """
    return chunks.groupBy("conv_id").applyInPandasWithState(
        _lines_state, LINE_OUT, LINE_STATE, "append", GroupStateTimeout.NoTimeout)


HIST_OUT = "session_id long, pos long, url string"
HIST_STATE = "stack array<string>"


def _history_state(cap: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        session = key[0]
        stack = list(state.get[0]) if state.exists else []
        parts = [p for p in pdfs]
        pdf = pd.concat(parts) if parts else pd.DataFrame(columns=["ts", "seq", "op", "url"])
        for op, url in pdf.sort_values(["ts", "seq"])[["op", "url"]].itertuples(index=False):
            if op == "back":
                if len(stack) >= 2:
                    stack.pop()
            elif not stack or stack[-1] != url:
                stack.append(url)
                if len(stack) > cap:
                    del stack[0]
        was = len(state.get[0]) if state.exists else 0
        state.update((stack,))
        urls = stack + [None] * (was - len(stack))  # NULL: the position is gone
        yield pd.DataFrame({"session_id": pd.Series([session] * len(urls), dtype="int64"),
                            "pos": pd.Series(range(len(urls)), dtype="int64"), "url": pd.Series(urls, dtype="object")})
    return fn


def history_stream(events: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """K4 on a stream: the session's history after each micro-batch (update mode); a
    position that is no longer there comes once more with a NULL url."""
    return events.groupBy("session_id").applyInPandasWithState(
        _history_state(cap), HIST_OUT, HIST_STATE, "update", GroupStateTimeout.NoTimeout)


TASK_SCHEMA = "session_id long, ts timestamp, seq long, event string, view_id string"
TASK_OUT = "session_id long, view_id string, status string"
TASK_STATE = "last map<string, string>"


def _task_state_fn(key, pdfs: Iterator[pd.DataFrame], state):
    """K5: per session, the last task event per view since the last navigate."""
    session = key[0]
    last = dict(state.get[0]) if state.exists and state.get[0] is not None else {}
    was = set(last)
    parts = [p for p in pdfs]
    if parts:
        pdf = pd.concat(parts).sort_values(["ts", "seq"])
        for event, view in pdf[["event", "view_id"]].itertuples(index=False):
            if event == "navigate":
                last = {}
            else:
                last[view] = event
    state.update((last,))
    label = {v: "loading" if e == "loading" else "loaded" for v, e in last.items()}
    views = sorted(was | set(last))  # a view that the navigate took away comes with a NULL status
    yield pd.DataFrame({"session_id": pd.Series([session] * len(views), dtype="int64"), "view_id": pd.Series(views, dtype="object"),
                        "status": pd.Series([label.get(v) for v in views], dtype="object")})


def task_status_stream(events: DataFrame) -> DataFrame:
    """K5 on a stream: a session's view states after each micro-batch (update mode).

    ``error`` counts as loaded; a ``navigate`` resets the session, and views that it takes away
    come once more with a NULL status.  State is one
    small map per session (at most one entry per view).
    """
    return events.groupBy("session_id").applyInPandasWithState(
        _task_state_fn, TASK_OUT, TASK_STATE, "update", GroupStateTimeout.NoTimeout)
