"""Model completion as a Spark stage (A5, L1, L2, L4).

The caller supplies ``make_client(model) -> complete`` where
``complete(prompt) -> Iterable[str]`` yields response chunks.  Requests are
processed by ``mapInArrow``: one Python worker per partition, clients created
once per partition and model, Arrow batches in and out, no per-row UDF.

Per request the output is its non-empty chunks in order and, when the call
fails, one final error row: chunks already produced stay, the failure adds an
``auth`` / ``runtime`` / ``unexpected`` row (``error_kind``, ``error``).  A
model whose client cannot be created falls back to the default model (L4).
Chunks leave as they come; only what follows the last line end is held back, since
an error takes the open line away (N11).

``complete_logged`` keeps what was answered: a request is named by the hash of its
model and prompt, requests that the log has answers for are not sent again, and equal
requests are sent once.  The rest go in rounds, each a committed part of the log, so that a
job that fails repeats one round at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DEFAULT_MODEL
from .views import error_content

CHUNK_SCHEMA = ("page_id long, view_id string, model string, seq long, chunk string, "
                "error_kind string, error string")


class CompletionAuthError(Exception):
    """Raised by a completion function when the provider rejects the credentials."""


def _responses(complete, prompt: str) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(chunk, error_kind, error) of a request as they come.

    ``held`` is the last chunk with a line end and what followed it: the part behind the line end is
    the open line, which goes if the request fails.
    """
    held: list[str] = []
    kind = error = None
    try:
        if complete is None:
            kind, error = "unavailable", "no client"
        else:
            for chunk in complete(prompt):
                if chunk:
                    if "\n" in chunk:
                        yield from ((c, None, None) for c in held)
                        held = []
                    held.append(chunk)
    except CompletionAuthError as e:
        kind, error = "auth", str(e)
    except RuntimeError as e:
        kind, error = "runtime", str(e)
    except Exception as e:  # noqa: BLE001 - classified as unexpected
        kind, error = "unexpected", str(e)
    if kind is None:
        yield from ((c, None, None) for c in held)
    else:
        if held and "\n" in held[0]:
            yield held[0][:held[0].rindex("\n") + 1], None, None
        yield None, kind, error


def _run(make_client: Callable[[str], Callable[[str], Iterable[str]] | None], default_model: str, keys: list[str], schema: pa.Schema, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: dict[str, Callable | None] = {}

        def client_for(model: str):
            if model not in clients:
                try:
                    clients[model] = make_client(model)
                except Exception:  # noqa: BLE001 - creation failure means "no client"
                    clients[model] = None
            c = clients[model]
            if c is None and model != default_model:
                return client_for(default_model)
            return c, model

        out: list[tuple] = []
        for b in batches:
            for *key, model, prompt in zip(*(b.column(c).to_pylist() for c in [*keys, "model", "prompt"]), strict=True):
                complete, used = client_for(model)
                for seq, row in enumerate(_responses(complete, prompt)):
                    out.append((*key, used, seq, *row))
                    if len(out) >= rows:
                        yield _batch(out, schema)
                        out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_OUT = [("model", pa.string()), ("seq", pa.int64()), ("chunk", pa.string()), ("error_kind", pa.string()), ("error", pa.string())]


def _completed(requests: DataFrame, make_client, default_model: str, keys: dict[str, pa.DataType], rows: int) -> DataFrame:
    schema = pa.schema([*keys.items(), *_OUT])
    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    out = requests.select(*keys, "model", "prompt").mapInArrow(_run(make_client, default_model, list(keys), schema, rows), ddl)
    return out.withColumn(
        "chunk", F.when(F.col("error_kind").isin("auth", "runtime", "unexpected"),
                        error_content(F.col("error_kind"), F.col("model"), F.col("error")))
        .otherwise(F.col("chunk")))


def complete_requests(requests: DataFrame, make_client, default_model: str = DEFAULT_MODEL, rows: int = 256) -> DataFrame:
    """L1: ``requests(page_id, view_id, model, prompt)`` -> chunk rows (``CHUNK_SCHEMA``).

    Error rows carry their display text in ``chunk`` (L2) as the last piece of the
    response.  ``rows`` chunks leave a task at a time.
    """
    return _completed(requests, make_client, default_model, {"page_id": pa.int64(), "view_id": pa.string()}, rows)


LOG_SCHEMA = "request string, model string, seq long, chunk string, error_kind string, error string"


def fingerprint(model: Column, prompt: Column) -> Column:
    """The request's name: SHA-256 over the model's length, the model and the prompt."""
    m, p = F.coalesce(model, F.lit("")), F.coalesce(prompt, F.lit(""))
    return F.sha2(F.concat(F.length(m).cast("string"), F.lit(":"), m, p), 256)


def logged(spark: SparkSession, log_dir: str) -> DataFrame:
    """The log's chunk rows (``LOG_SCHEMA``); a log that is not there yet has none.

    A part that a job was writing when it failed was not committed and has no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(log_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f"{log_dir}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return spark.read.schema(LOG_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], LOG_SCHEMA)


def _answered(log: DataFrame) -> DataFrame:
    """Requests with a whole answer: an answer's rows are committed together, a failed one has an error."""
    return log.groupBy("request").agg(F.max("error_kind").alias("e")).where("e is null").select("request")


def complete_logged(requests: DataFrame, make_client, log_dir: str, default_model: str = DEFAULT_MODEL, rounds: int = 8) -> DataFrame:
    """L1 with a log: chunk rows of ``requests``, of which only those without an answer in the log are sent.

    ``rounds``: into how many committed parts they go.  Requests that failed are sent again by
    the next call; their last error stands until then.  A request whose answer is empty has no rows, so it is
    sent again too.
    """
    spark = requests.sparkSession
    named = requests.select("page_id", "view_id", "model", "prompt", fingerprint(F.col("model"), F.col("prompt")).alias("request"))
    once = named.select("request", "model", "prompt").dropDuplicates(["request"])
    for k in range(rounds):
        due = once.where(F.pmod(F.xxhash64("request"), F.lit(rounds)) == k).join(_answered(logged(spark, log_dir)), "request", "left_anti")
        _completed(due, make_client, default_model, {"request": pa.string()}, 256).write.parquet(f"{log_dir}/{uuid.uuid4().hex}")
    log = logged(spark, log_dir).withColumn("part", F.input_file_name())
    # an answer counts before errors; of several errors the last part's by name
    best = log.groupBy("request", F.regexp_extract("part", "([0-9a-f]{32})/[^/]*$", 1).alias("of")).agg(F.max("error_kind").alias("e"))
    best = best.groupBy("request").agg(F.max(F.struct(F.col("e").isNull(), "of")).alias("b")).select("request", F.col("b.of").alias("of"))
    rows = log.withColumn("of", F.regexp_extract("part", "([0-9a-f]{32})/[^/]*$", 1)).join(best, ["request", "of"], "left_semi")
    return named.select("page_id", "view_id", "request").join(rows.drop("part", "of"), "request").select(
        "page_id", "view_id", "model", "seq", "chunk", "error_kind", "error")
