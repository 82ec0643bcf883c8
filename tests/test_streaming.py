"""Streaming forms equal the batch results (K1-K4)."""

import datetime as dt
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF
from weftview.operators import chunks as C
from weftview.operators import navigation as N
from weftview.plans.batch import page_views
from weftview.streaming import jobs as J


def _scratch():
    return tempfile.mkdtemp(prefix="weftview-test-")


def test_page_views_stream_equals_batch(spark):
    src = _scratch()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages.repartition(3).write.mode("overwrite").parquet(src)
    out, ckpt = _scratch(), _scratch()
    q = J.stream_page_views(spark, src, out, ckpt, files_per_batch=2)
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{out}/views")
    assert streamed.select("epoch").distinct().count() == 2
    streamed = streamed.select("page_id", "url", "view_id", "content")
    batch = page_views(pages)
    assert streamed.count() == 2 * pages.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert spark.read.parquet(f"{out}/links").count() > 0


def _run_batches(spark, fn, schema, batches, name, mode):
    """The rows that `fn` puts out over a stream whose micro-batches are the given lists of rows."""
    src = _scratch()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1 if i + 1 < len(batches) else 0)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (fn(stream).writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", _scratch()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def test_lines_carry_over_batches(spark):
    got = _run_batches(spark, J.response_lines_stream, J.CHUNK_SCHEMA,
                       [[(1, 0, "Hel", False), (2, 0, "a\n\nb", False)], [(1, 1, "lo\nWor", False), (2, 1, None, True)], [(1, 2, "ld", True)]],
                       "lines_over_batches", "append")
    assert sorted(got) == [(1, 0, "Hello\n"), (1, 1, "World"), (2, 0, "a\n"), (2, 1, "\n"), (2, 2, "b")]


def test_history_and_tasks_signal_what_is_gone(spark):
    t = dt.datetime(2024, 1, 1)
    got = _run_batches(spark, J.history_stream, J.NAV_SCHEMA,
                       [[(1, t, 0, "visit", "a"), (1, t, 1, "visit", "b")], [(1, t, 2, "back", None)]], "history_over_batches", "update")
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 0, "a"), (1, 1, None)]
    got = _run_batches(spark, J.task_status_stream, J.TASK_SCHEMA,
                       [[(1, t, 0, "loading", "raw")], [(1, t, 1, "navigate", None), (1, t, 2, "loaded", "summary")]], "tasks_over_batches", "update")
    assert got == [(1, "raw", "loading"), (1, "raw", None), (1, "summary", "loaded")]


def test_lines_stream_equals_batch(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    chunks = conv.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    last = chunks.groupBy("conv_id").agg(F.max("seq").alias("m"))
    chunks = chunks.join(last, "conv_id").withColumn("is_last", F.col("seq") == F.col("m")).drop("m")
    src = _scratch()
    chunks.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(J.CHUNK_SCHEMA).parquet(src)
    q = (J.response_lines_stream(stream).writeStream.format("memory").queryName("lines_out")
         .outputMode("append").option("checkpointLocation", _scratch()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM lines_out")
    want = C.response_lines(chunks, ["conv_id"]).select("conv_id", "line_no", "line")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_history_stream_equals_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "back").otherwise("visit").alias("op"),
        F.concat(F.lit("u"), F.get_json_object("props", "$.k")).alias("url"))
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    src = _scratch()
    ev.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(J.NAV_SCHEMA).parquet(src)
    q = (J.history_stream(stream).writeStream.format("memory").queryName("hist_out")
         .outputMode("update").option("checkpointLocation", _scratch()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM hist_out")
    want = N.history(ev)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_task_status_stream_equals_batch(spark):
    from weftview.plans.sessions import TASK_EVENTS, TASK_VIEWS

    ev = spark.read.parquet(f"{SF}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    mapping = F.create_map(*[F.lit(x) for kv in TASK_EVENTS.items() for x in kv])
    te = ev.where(F.col("event_type").isin(*TASK_EVENTS)).select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), mapping[F.col("event_type")].alias("event"),
        F.element_at(F.array(*[F.lit(v) for v in TASK_VIEWS]),
                     (F.pmod(k, F.lit(len(TASK_VIEWS))) + 1).cast("int")).alias("view_id"))
    src = _scratch()
    te.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(J.TASK_SCHEMA).parquet(src)
    q = (J.task_status_stream(stream).writeStream.format("memory").queryName("task_out")
         .outputMode("update").option("checkpointLocation", _scratch()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM task_out")
    last_nav = te.where("event = 'navigate'").groupBy("session_id").agg(
        F.max(F.struct("ts", "seq")).alias("nav_at"))
    t = te.where("event <> 'navigate'").join(last_nav, "session_id", "left").where(
        F.col("nav_at").isNull() | (F.struct("ts", "seq") > F.col("nav_at")))
    want = t.groupBy("session_id", "view_id").agg(F.max_by("event", F.struct("ts", "seq")).alias("e")) \
        .select("session_id", "view_id",
                F.when(F.col("e") == "loading", "loading").otherwise("loaded").alias("status"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
