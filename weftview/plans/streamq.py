"""Registered queries that run as streams over the given tables, and the completion stage
(K1-K5, L1, L2, L4).

Each stream reads a table's files with ``availableNow``, writes its micro-batches by epoch to a
folder of its own under ``spark.checkpoint.dir`` and ends; the query returns what the sink then
holds.  A table is read as one micro-batch, since its files are not in order of time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_MODEL
from ..functions.sqltext import lit
from ..operators.completion import CompletionAuthError, complete_requests
from ..session import checkpoint_dir
from ..sources.tables import table
from ..streaming import jobs as J
from . import linkq, sessions, viewq


def _run_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern stands for one file as well as for a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d.rstrip('/')}/{name}.parque[t]")


def _sink(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives, with the epoch they came in."""
    spark = stream.sparkSession
    out = _run_dir(spark)

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, epoch long").option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key's last epoch, if it is not NULL (a NULL takes the key away)."""
    return rows.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value)).where(F.col(value).isNotNull())


def stream_page_links(spark, d):
    """K1, K3: pages rendered and their links extracted as they arrive; the links that the sink holds."""
    out = _run_dir(spark)
    q = J.stream_page_views(spark, f"{d.rstrip('/')}/pages.parque[t]", out, f"{out}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/links").select("page_id", "link_idx", "text", "target", "start_pos", "end_pos")


def stream_response_lines(spark, d):
    """K2: lines as they complete; a response ends with its last turn, found in the stored table."""
    ends = table(spark, d, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.max("turn").alias("end"))
    c = _source(spark, d, "conversations").join(ends, "conv_id")
    chunks = c.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("chunk"), (F.col("turn") == F.col("end")).alias("is_last"))
    return _sink(J.response_lines_stream(chunks), "append").drop("epoch")


def stream_history(spark, d):
    """K4: the histories after the last micro-batch."""
    ev = sessions.nav_from(_source(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return _latest(_sink(J.history_stream(ev.select("session_id", "ts", "seq", "op", "url")), "update"), ["session_id", "pos"], "url")


def stream_task_status(spark, d):
    """K5: the states of a session's views after the last micro-batch."""
    ev = sessions.tasks_from(_source(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return _latest(_sink(J.task_status_stream(ev.select("session_id", "ts", "seq", "event", "view_id")), "update"), ["session_id", "view_id"], "status")


# --- fixed values: the deterministic client; which prompts fail, by their length ------------
FAIL_OF, AUTH, BREAKS, ODD = 11, 3, 5, 7
NO_MODEL = "gpt-4o-mini"  # a model whose client can't be made: the default model answers


def answer(prompt: str) -> Iterator[str]:
    """Two lines and an open one about the prompt; some prompts are refused or break off in a line."""
    n = len(prompt)
    if n % FAIL_OF == AUTH:
        raise CompletionAuthError("refused")
    yield f"{n} characters\n"
    yield ""
    yield "half a "
    if n % FAIL_OF == BREAKS:
        raise RuntimeError("connection lost")
    if n % FAIL_OF == ODD:
        raise ValueError("no such answer")
    yield "line\n"
    yield prompt[:10]


def make_client(model: str):
    if model == NO_MODEL:
        raise RuntimeError("no such model")
    return answer


def completions(spark, d):
    """L1, L2, L4: every view's prompt on the loaded pages, answered in chunks by the client above."""
    return complete_requests(viewq.prompts(spark, d, eager_only=False), make_client).select(
        "page_id", "view_id", "model", "seq", "chunk", "error_kind")


QUERIES = {
    "stream_page_links": stream_page_links,
    "stream_response_lines": stream_response_lines,
    "stream_history": stream_history,
    "stream_task_status": stream_task_status,
    "completions": completions,
}

_TEXT = {"auth": f"'## 🔐 Authentication Error' || chr(10) || chr(10) || 'Authentication failed for model ' || chr(39) || {lit(DEFAULT_MODEL)} || chr(39) "
                 f"|| '. Please set a valid API key for ' || split_part({lit(DEFAULT_MODEL)}, '/', 1) || '.'",
         "runtime": "'## ❌ Error' || chr(10) || chr(10) || 'connection lost'",
         "unexpected": "'## ❌ Unexpected Error' || chr(10) || chr(10) || 'no such answer'"}
_KIND = f"CASE length(prompt) % {FAIL_OF} WHEN {AUTH} THEN 'auth' WHEN {BREAKS} THEN 'runtime' WHEN {ODD} THEN 'unexpected' END"

ORACLE = {
    "stream_page_links": linkq.ORACLE["links"],
    "stream_response_lines": sessions.ORACLE["response_lines"],
    "stream_history": sessions.ORACLE["nav_history"],
    "stream_task_status": f"SELECT session_id, view_id, status FROM ({sessions.ORACLE['task_status']})",
    "completions": f"""SELECT page_id, view_id, {lit(DEFAULT_MODEL)} AS model, seq, chunk, error_kind FROM (
  SELECT page_id, view_id, unnest(range(len(chunks)))::BIGINT AS seq, unnest(chunks) AS chunk,
    unnest(CASE WHEN kind IS NULL THEN [NULL::VARCHAR, NULL, NULL, NULL] WHEN kind = 'auth' THEN ['auth'] ELSE [NULL, kind] END) AS error_kind
  FROM (SELECT *, CASE kind WHEN 'auth' THEN [{_TEXT['auth']}] WHEN 'runtime' THEN [n || ' characters' || chr(10), {_TEXT['runtime']}]
      WHEN 'unexpected' THEN [n || ' characters' || chr(10), {_TEXT['unexpected']}]
      ELSE [n || ' characters' || chr(10), 'half a ', 'line' || chr(10), prompt[1:10]] END AS chunks
    FROM (SELECT *, length(prompt) AS n, {_KIND} AS kind FROM ({viewq.prompts_sql(eager_only=False)}))))""",
}
