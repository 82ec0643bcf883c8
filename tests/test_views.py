"""View catalogue, tasks, requests and completion."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftview.operators import views as V
from weftview.operators.completion import CompletionAuthError, complete_logged, complete_requests, logged


def test_validation_quarantines_bad_rows_only(spark):
    rows = list(V.DEFAULT_VIEWS) + [
        ("bad", "Bad", "", "6", True, False, "", "", "p", "", 5),
        ("two", "Two", "xy", "7", True, False, "", "", "p", "", 6),
        ("txt", "Txt", "t", " 8 ", True, False, "", "", "p", "", 7),
        ("nan", "Nan", "n", "eight", True, False, "", "", "p", "", 8),
        ("off", "Off", "o", "9", False, False, "", "", "p", "", 9),
        ("eli5", "ELI5 again", "e", "10", True, False, "", "", "p2", "", 10),
    ]
    good, bad = V.validate(V.catalog(spark, rows))
    assert sorted(r.id for r in bad.collect()) == ["bad", "nan", "two"]
    ready = {r.id: r for r in V.enabled_views(good).collect()}
    assert "off" not in ready and ready["txt"].order == 8
    assert ready["eli5"].name == "ELI5 again"  # the later duplicate wins


def test_fan_out_only_eager_views(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    eager = [v for v in V.view_specs(spark) if v["auto_load"]]
    t = V.fan_out(pages, eager, {"view_id": "id"})
    assert t.count() == 6 and {r.view_id for r in t.collect()} == {"raw", "terminal"}
    assert V.fan_out(pages, [], {"view_id": "id"}).count() == 0


def test_model_precedence_and_request(spark):
    df = spark.createDataFrame([(" gpt-x ",), ("",), ("   ",), (None,)], "m string")
    got = [r[0] for r in df.select(V.task_model(F.col("m"))).collect()]
    assert got == ["gpt-x", V.DEFAULT_MODEL, V.DEFAULT_MODEL, V.DEFAULT_MODEL]
    over = [r[0] for r in df.select(V.task_model(F.col("m"), "env/model")).collect()]
    assert set(over) == {"env/model"}
    req = spark.range(1).select(V.chat_request(F.lit("m"), F.lit("P"), F.lit("C"),
                                               options=F.create_map(F.lit("temperature"), F.lit("0.7")))
                                .alias("r")).first().r
    assert req.messages[0].content == "P\n\nC" and req.temperature == 0.7 and req.max_tokens == 8192
    alone = spark.range(1).select(V.chat_request(F.lit("m"), F.lit("P")).alias("r")).first().r
    assert alone.messages[0].content == "P" and alone.stream


def test_option_layers_by_precedence(spark):
    import json

    layers = ['{"temperature": 1, "max_tokens": 7, "a": {"x": [1, "1"]}, "s": "1"}', '{"max_tokens": 8, "base": "u", "a": null}', '{"max_tokens": 9, "api_key": "k", "z": true}']
    base = {"model": "m", "messages": [{"role": "user", "content": 'P "q"\n\nC'}], "temperature": 0.2, "max_tokens": 8192, "stream": True}
    rows = [tuple(x if k >> i & 1 else None for i, x in enumerate(layers)) for k in range(8)] + [("", "no json", "[1]"), (layers[0], '{"max_tokens": null}', None)]
    df = spark.createDataFrame(rows, "c string, e string, k string")
    out = df.withColumn("r", V.request_json(F.lit("m"), F.lit('P "q"'), F.lit("C"), F.col("c"), F.col("e"), F.col("k"))).collect()
    for r in out:
        want = dict(base)
        for x in (r.c, r.e, r.k):
            if x and x.startswith("{"):
                want.update(json.loads(x))
        want.pop("api_key", None)
        got = json.loads(r.r)
        assert got == want and {k: type(v) for k, v in got.items()} == {k: type(v) for k, v in want.items()}
    typed = df.limit(1).select(V.read_request(V.request_json(F.lit("m"), F.lit("P"))).alias("r")).first().r
    assert typed.messages[0].content == "P" and typed.temperature == 0.2 and typed.stream


def test_status_label_and_prefix(spark):
    df = spark.createDataFrame([("loading", "A"), ("loaded", "B"), (None, "C")], "s string, n string")
    assert [r[0] for r in df.select(V.status_label(F.col("s"), F.col("n"))).collect()] == ["⏳ A", "✓ B", "C"]
    ids = spark.createDataFrame([("--content-tab-summary",), ("raw",)], "i string")
    assert [r[0] for r in ids.select(V.normalize_view_id(F.col("i"))).collect()] == ["summary", "raw"]


# The fake client lives in this test module; ship it by value to the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _make_client(model):
    if model == "broken":
        raise RuntimeError("cannot create")

    def complete(prompt):
        if "auth" in prompt:
            raise CompletionAuthError("bad key")
        yield "one "
        yield ""
        yield "two"
        if "boom" in prompt:
            yield " three\nfour"
            raise RuntimeError("stream died")
    return complete


def test_completion_chunks_errors_and_fallback(spark):
    reqs = spark.createDataFrame(
        [(1, "v", "openai/gpt", "ok"), (2, "v", "openai/gpt", "auth please"),
         (3, "v", "m", "boom"), (4, "v", "broken", "ok")],
        "page_id long, view_id string, model string, prompt string")
    out = complete_requests(reqs, _make_client, default_model="fallback").orderBy("page_id", "seq").collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    assert [r.chunk for r in by[1]] == ["one ", "two"]
    assert by[2][0].error_kind == "auth" and "openai" in by[2][0].chunk
    assert [r.chunk for r in by[3]][:-1] == ["one ", "two", " three\n"]  # the open line is lost
    assert [r.error_kind for r in by[3]] == [None, None, None, "runtime"]
    assert by[3][-1].chunk == "## ❌ Error\n\nstream died"
    assert by[4][0].model == "fallback" and by[4][0].chunk == "one "


def test_chunks_leave_before_the_request_ends():
    from weftview.operators.completion import _responses

    sent = []

    def complete(prompt):
        for c in ("a\n", "b", "\n", "c"):
            sent.append(c)
            yield c

    got = [(c, list(sent)) for c, _, _ in _responses(complete, "")]
    assert [c for c, _ in got] == ["a\n", "b", "\n", "c"]
    assert got[0][1] == ["a\n", "b", "\n"]  # two chunks later: its line end is certain to stay


class _Stop(BaseException):
    """Not an error of a request: it takes the task down."""


def _counting(folder, stops=()):
    import os
    import uuid

    def make_client(model):
        def complete(prompt):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{model}|{prompt}")
            if prompt in stops:
                raise _Stop
            if "boom" in prompt:
                raise RuntimeError("no")
            yield f"{prompt}\n"
            yield model
        return complete
    return make_client


def _sent(folder):
    out = {}
    for f in folder.iterdir():
        out[f.read_text()] = out.get(f.read_text(), 0) + 1
    return out


def test_logged_requests_are_sent_once(spark, tmp_path):
    log, first, again = str(tmp_path / "log"), tmp_path / "a", tmp_path / "b"
    first.mkdir()
    again.mkdir()
    rows = [(i, "v", "m", f"p{i % 30}") for i in range(60)] + [(60, "v", "m", "boom"), (61, "w", "m2", "p1"), (62, "v", None, "p1"), (63, "v", "m", None)]
    reqs = spark.createDataFrame([r for r in rows if r[2] and r[3]], "page_id long, view_id string, model string, prompt string")
    stops = {f"p{i}" for i in (4, 17)}
    with pytest.raises(Exception, match="_Stop"):
        complete_logged(reqs, _counting(str(first), stops), log)
    kept = {r.chunk.strip() for r in logged(spark, log).where("seq = 0 and error_kind is null").collect()}
    assert kept and not kept & stops  # rounds before the one that failed are in the log
    out = complete_logged(reqs, _counting(str(again)), log)
    sent = _sent(again)
    assert set(sent.values()) == {1} and not {f"m|{p}" for p in kept if p != "p1"} & set(sent)
    got = {}
    for r in out.orderBy("page_id", "seq").collect():
        got.setdefault((r.page_id, r.view_id), []).append((r.model, r.chunk, r.error_kind))
    assert got[7, "v"] == got[37, "v"] == [("m", "p7\n", None), ("m", "m", None)] and got[61, "w"][1][1] == "m2"
    assert got[60, "v"] == [("m", "## ❌ Error\n\nno", "runtime")] and len(got) == 62
    third = tmp_path / "c"
    third.mkdir()
    assert complete_logged(reqs, _counting(str(third)), log).count() == out.count()
    assert _sent(third) == {"m|boom": 1}  # only what failed is asked again


def test_settings_overlay_and_view_replacement(spark):
    base = spark.createDataFrame([("settings", "max_history", "50"), ("ai", "default_model", "m1"),
                                  ("ui", "show_icons", "true")], "section string, key string, value string")
    over = spark.createDataFrame([("ai", "default_model", "m2"), ("settings", "app_title", "X")],
                                 "section string, key string, value string")
    got = {(r.section, r.key): r.value for r in V.settings_overlay(base, over).collect()}
    assert got == {("settings", "max_history"): "50", ("ai", "default_model"): "m2",
                   ("ui", "show_icons"): "true", ("settings", "app_title"): "X"}
    defaults = V.catalog(spark)
    own = V.catalog(spark, [("mine", "Mine", "m", "1", True, True, "", "", "p", "", 0)])
    assert [r.id for r in V.views_overlay(defaults, own).collect()] == ["mine"]
    assert V.views_overlay(defaults, own.where("false")).count() == len(V.DEFAULT_VIEWS)


def test_focus_links(spark):
    links = spark.createDataFrame([(1, "raw", 0), (1, "summary", 0), (2, "raw", 0)],
                                  "session_id long, view_id string, link_idx long")
    focus = spark.createDataFrame([(1, "summary"), (2, "raw")], "session_id long, view_id string")
    got = sorted((r.session_id, r.view_id, r.selected_idx)
                 for r in V.focus_links(links, focus, ["session_id"]).collect())
    assert got == [(1, "summary", -1), (2, "raw", -1)]
