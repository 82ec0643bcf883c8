"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftview.session import checkpoint_dir

#: Rows up to which a side of (id)-sized rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file: in $TOKENIZER_DIR, or where the package has it."""
    if "TOKENIZER_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def saved(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage: written as Parquet to the shared checkpoint folder and read
    back, so that what follows survives a lost executor without computing it again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` marked for broadcast if it is counted to hold at most `rows` rows, else as it is."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


def summed_cells(counts: DataFrame) -> np.ndarray:
    """Sum of the dense count arrays in rows (chunk int, cells binary of uint32) by chunk.

    Every task sends one array of a fixed number of cells, in chunks; the sum is as large as
    one of them, whatever the corpus, so that it may come to the driver and be broadcast."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for k, x in zip(b["chunk"], b["cells"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        yield pd.DataFrame({"chunk": list(total), "cells": [x.tobytes() for x in total.values()]})

    got = counts.repartition("chunk").mapInPandas(add, "chunk int, cells binary").collect()
    return np.concatenate([np.frombuffer(r["cells"], np.int64) for r in sorted(got, key=lambda r: r["chunk"])]) if got else np.zeros(0, np.int64)


def cell_rows(cells: np.ndarray, chunk: int = 1 << 12) -> pd.DataFrame:
    """Rows for summed_cells from one task's counts."""
    parts = [cells[i:i + chunk].astype(np.uint32) for i in range(0, len(cells), chunk)]
    return pd.DataFrame({"chunk": np.arange(len(parts), dtype=np.int32), "cells": [p.tobytes() for p in parts]})


def cell_batches(cells: np.ndarray, chunk: int = 1 << 12, rows: int = 64) -> Iterator[pd.DataFrame]:
    """The rows of cell_rows, some at a time: all at once are several copies of the counts in memory."""
    for i in range(0, len(cells), rows * chunk):
        part = cell_rows(cells[i:i + rows * chunk], chunk)
        part["chunk"] += i // chunk
        yield part


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
          "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}


def give_back() -> None:
    """Returns what a task no longer needs to the system: workers are reused, and idle ones hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """`fn` over Arrow batches: it gets dicts of Python lists (null is None, integers stay exact)
    and yields dicts of lists or arrays with the columns of `schema` ("name type, ...")."""
    rows = 1000  # at a time as Python objects
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for out in fn({c: p.column(c).to_pylist() for c in p.schema.names} for p in parts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)
        out = None
        give_back()

    return df.mapInArrow(each, schema)
