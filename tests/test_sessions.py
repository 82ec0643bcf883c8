"""History, chunks, lines and snapshots."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftview.operators import chunks as C
from weftview.operators import navigation as N


def nav_df(spark, events):
    base = dt.datetime(2024, 1, 1)
    rows = [(s, base + dt.timedelta(minutes=37 * i), i, op, url, ok)
            for i, (s, op, url, ok) in enumerate(events)]
    return spark.createDataFrame(rows, "session_id long, ts timestamp, seq long, op string, url string, ok boolean")


def py_history(events, cap=50):
    st = {}
    for s, op, url, _ in events:
        h = st.setdefault(s, [])
        if op == "back":
            if len(h) >= 2:
                h.pop()
        elif not h or h[-1] != url:
            h.append(url)
            if len(h) > cap:
                del h[0]
    return st


def test_history_fold_matches_python(spark):
    rnd = random.Random(7)
    events = []
    for s in range(4):
        for _ in range(rnd.randint(0, 300)):
            op = "back" if rnd.random() < 0.2 else "visit"
            events.append((s, op, f"u{rnd.randint(0, 6)}", rnd.random() > 0.1))
    events += [(9, "visit", f"p{i}", True) for i in range(60)]  # cap
    events += [(10, "back", "x", True), (11, "visit", "a", True), (11, "back", "x", True),
               (12, "visit", "a", True), (12, "visit", "b", True), (12, "back", "x", True)]
    got = {}
    for r in N.history(nav_df(spark, events)).orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append(r.url)
    want = {s: h for s, h in py_history(events).items() if h}
    assert got == want
    assert len(got[9]) == 50 and got[9][0] == "p10"
    assert got[11] == ["a"] and got[12] == ["a"]


def test_dedup_last_n_and_current_page(spark):
    events = [(1, "visit", "a", True), (1, "visit", "a", True), (1, "visit", "b", True),
              (1, "visit", "a", False), (1, "back", "x", True), (1, "visit", "a", True)]
    ev = nav_df(spark, events)
    kept = [r.url for r in N.visits_deduped(ev).orderBy("seq").collect()]
    assert kept == ["a", "b", "a"]  # adjacent repeats dropped, non-adjacent stay
    last = N.last_n(N.visits_deduped(ev), 2).orderBy("from_end").collect()
    assert [r.url for r in last] == ["a", "b"]
    cur = [r.current_url for r in N.current_page(ev).orderBy("seq").collect()]
    assert cur == ["a", "a", "b", "b", "b", "a"]  # a failed load keeps the current page, and back goes from it to b


def py_shown(events, cap):
    """(page shown after each event, final history) of one session's (op, url, ok)."""
    h, cur, out = [], None, []
    for op, url, ok in events:
        if op == "back":
            if len(h) >= 2:
                h.pop()
                cur = h[-1] if ok and h[-1] is not None else cur
        else:
            if not h or h[-1] != url:
                h.append(url)
                h = h[-cap:]
            cur = url if ok and url is not None else cur
        out.append(cur)
    return out, h


def test_back_returns_to_the_entry_before(spark):
    events = [(1, "back", None, True), (1, "visit", "a", True), (1, "back", None, True), (1, "visit", "b", True), (1, "back", None, True),
              (1, "visit", "c", False), (1, "visit", "d", True), (1, "back", None, False), (1, "back", None, True)]
    cur = [r.current_url for r in N.current_page(nav_df(spark, events)).orderBy("seq").collect()]
    assert cur == [None, "a", "a", "b", "a", "a", "d", "d", "a"]
    assert cur == py_shown([e[1:] for e in events], 50)[0]
    assert N.current_page(nav_df(spark, events[:0])).collect() == [] and N.history(nav_df(spark, events[:0])).collect() == []


@given(st.integers(1, 6), st.lists(st.tuples(st.sampled_from(["visit", "visit", "back"]), st.sampled_from("abcd")), max_size=60),
       st.lists(st.integers(0, 60), max_size=6))
@settings(max_examples=1500, deadline=None)
def test_steps_of_runs_play_as_the_events(cap, events, cuts):
    stack = []
    cuts = sorted({0, len(events), *(c for c in cuts if c < len(events))})
    for a, b in zip(cuts, cuts[1:]):
        run = N._Run(cap)
        for e in events[a:b]:
            run.event(*e)
        for step in run.steps():
            N.play(stack, *step, cap)
        assert stack == py_shown([(*e, True) for e in events[:b]], cap)[1]


@pytest.mark.parametrize("cap, buckets", [(2, 40), (5, 7), (50, 16)])
def test_histories_and_pages_over_buckets(spark, cap, buckets):
    rnd = random.Random(cap)
    events = []
    for s in [None, 0, 1, 2, 2, 2, 3]:
        back = rnd.choice([0.2, 0.5, 0.6])
        events += [(s, "back" if rnd.random() < back else "visit", rnd.choice(["a", "b", "c", None, f"u{rnd.randint(0, 40)}"]), rnd.random() > 0.2)
                   for _ in range(rnd.randint(50, 200))]
    ev = nav_df(spark, events).withColumn("extra", F.lit(1))
    want_pages, want = {}, {}
    for s in {e[0] for e in events}:
        mine = [(i, e) for i, e in enumerate(events) if e[0] == s]
        shown, want[s] = py_shown([e[1:] for _, e in mine], cap)
        want_pages.update({i: p for (i, _), p in zip(mine, shown)})
    got = {}
    for r in N.history(ev, cap, buckets).orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append(r.url)
    assert got == {s: h for s, h in want.items() if h}
    pages = N.current_page(ev, buckets, cap)
    assert pages.columns == [*ev.columns, "current_url"]
    assert {r.seq: r.current_url for r in pages.collect()} == want_pages


def test_hot_session_is_folded_by_many_tasks(spark):
    """A third of 400,000 events in one session: few steps of it meet in one task."""
    n = 400_000
    ev = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1009 + 10).alias("session_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"),
        F.when(F.xxhash64("id") < 0, "back").otherwise("visit").alias("op"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).alias("url"), F.lit(True).alias("ok"))
    x = (ev.repartitionByRange(32, "session_id", "ts", "seq").sortWithinPartitions("session_id", "ts", "seq")
         .withColumn("bucket", F.spark_partition_id().cast("long")))
    steps = N.bucket_steps(x).where("session_id = 7")
    tasks, rows = steps.agg(F.countDistinct("bucket"), F.count("*")).first()
    assert tasks >= 8 and rows < 5_000
    hot = ev.where("session_id = 7").orderBy("seq").select("op", "url", "ok").collect()
    got = [r.url for r in N.history(ev, buckets=32).where("session_id = 7").orderBy("pos").collect()]
    assert got == py_shown(map(tuple, hot), 50)[1]


CHUNKS = {
    1: ["Hel", "lo\nWor", "ld\n", "", None, "tail"],
    2: ["a\n\nb", "\n"],
    3: ["no newline at all"],
    4: ["\n\n\n"],
}


def chunk_df(spark):
    rows = [(k, i, c) for k, cs in CHUNKS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "conv_id long, seq long, chunk string")


LINES = {
    1: ["Hello\n", "World\n", "tail"],
    2: ["a\n", "\n", "b\n"],
    3: ["no newline at all"],
    4: ["\n", "\n", "\n"],
}


def test_lines_of_split_chunks(spark):
    got = {}
    for r in C.response_lines(chunk_df(spark), ["conv_id"]).orderBy("conv_id", "line_no").collect():
        got.setdefault(r.conv_id, []).append(r.line)
    assert got == LINES
    assert all("".join(got[k]) == "".join(c or "" for c in v) for k, v in CHUNKS.items())


def test_snapshots_every_third_and_last(spark):
    rows = [(1, i, f"l{i}\n") for i in range(7)] + [(None, 0, "a\nb\n"), (None, 1, "\U0001f600\nd"), (2, 0, ""), (3, 0, "x\ny\nz\n")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, chunk string")
    got = {(r.conv_id, r.n_lines): r.content for r in C.snapshots(df, ["conv_id"]).collect()}
    want = {(1, n): "".join(f"l{i}\n" for i in range(n)) for n in (3, 6, 7)}
    assert got == want | {(None, 3): "a\nb\n\U0001f600\n", (None, 4): "a\nb\n\U0001f600\nd", (3, 3): "x\ny\nz\n"}
    assert C.snapshots(df.limit(0), ["conv_id"]).collect() == []


def test_snapshots_of_a_long_response_are_offsets(spark):
    n = 60_000
    df = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.concat(F.col("id"), F.lit("\n")).alias("chunk"))
    at = C.snapshot_offsets(C.response_lines(df, ["conv_id"]), ["conv_id"])
    assert at.count() == n // 3  # two numbers a snapshot; as texts these would be 3.5 GB
    end = {r.n_lines: r.end for r in at.where("n_lines in (3, 30000, 60000)").collect()}
    assert end == {k: sum(len(str(i)) + 1 for i in range(k)) for k in (3, 30_000, 60_000)}


def test_drop_empty(spark):
    assert C.drop_empty(chunk_df(spark)).count() == sum(1 for v in CHUNKS.values() for c in v if c)


def test_hot_session_is_split_and_still_exact(spark):
    from weftview.operators.sequence import range_buckets

    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(3)
    rows = []
    seq = 0
    for s in range(20):  # 20 ordinary sessions
        for i in range(30):
            rows.append((s, base + dt.timedelta(seconds=i * 60), seq, "visit", f"u{rnd.randint(0, 3)}", True))
            seq += 1
    for i in range(300):  # one session with a third of all rows, all in the same second
        rows.append((99, base, seq, "visit", f"u{rnd.randint(0, 2)}", True))
        seq += 1
    ev = spark.createDataFrame(rows, "session_id long, ts timestamp, seq long, op string, url string, ok boolean")
    b = range_buckets(ev, ["session_id"], ["ts", "seq"], n=16)
    hot_buckets = b.where("session_id = 99").select("_b").distinct().count()
    assert hot_buckets >= 3  # the hot session spans several range buckets
    got = {}
    for r in N.visits_deduped(ev, buckets=16).orderBy("seq").collect():
        got.setdefault(r.session_id, []).append(r.url)
    want, prev = {}, {}
    for s, _, _, _, url, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if prev.get(s) != url:
            want.setdefault(s, []).append(url)
        prev[s] = url
    assert got == want


def test_buckets_are_exact_whatever_spark_reuses(spark):
    """A session with a third of all events, an extra column kept, exchange reuse and AQE off."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ev = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("session_id"),
        F.timestamp_seconds(F.col("id") * 37 % 50_000).alias("ts"), F.col("id").alias("seq"), F.lit("visit").alias("op"),
        F.concat(F.lit("u"), F.xxhash64("id") % 3).alias("url"), (F.col("id") % 5 > 0).alias("ok"), F.col("id").alias("extra"))
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    want = ev.withColumn("p", F.lag("url").over(w)).where("not url <=> p").select("seq", "extra")
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, "true") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = N.visits_deduped(ev).select("seq", "extra")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
