"""Learned scores on held-out labels, and their edge cases."""

import math

import numpy as np
import pytest

from weftview.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def _auc(rows):
    rows = sorted(rows)
    rank, i = 0.0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        rank += sum(y for _, y in rows[i:j]) * (i + 1 + j) / 2
        i = j
    n1 = sum(y for _, y in rows)
    return (rank - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))


@pytest.mark.parametrize("name,label,least", [("op3_noisy_channel_toxicity", "toxic", 0.93), ("op5_byte_cnn_quality", "quality", 0.98)])
def test_held_out_ranking(spark, name, label, least):
    got = queries.queries()[name](spark, SF)
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label).collect()
    assert _auc([tuple(r) for r in rows]) > least


def test_held_out_languages(spark):
    got = queries.queries()["op6_ppm_language_id"](spark, SF).where("held_out")
    right = got.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert right > 0.99


@pytest.mark.parametrize("op", [toxicity, quality])
def test_edge_rows(spark, op):
    docs = spark.createDataFrame([(1, "fine words here", 0.1), (2, None, 0.2), (3, "", 0.3), (None, "x", 0.4), (1, "fine words here", 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, label int")
    rows = op.scored(docs, op.learn(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and math.isfinite(r.score) for r in rows)
    none = op.scored(docs, op.learn(docs, labels.where("label = 1")))
    assert {r.score for r in none.collect()} == {1.0}
    assert op.scored(docs.limit(0), op.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_long_texts_are_read_in_blocks_alike():
    net = quality.fresh()
    data = (b"some words of a text | and more " * 20_000)[:600_001]
    whole, block = quality.features(net, data), quality._BLOCK
    try:
        quality._BLOCK = 1 << 30
        one = quality.features(net, data)
    finally:
        quality._BLOCK = block
    assert abs(whole[:24] - one[:24]).max() < 1e-4 and abs(whole[24:] - one[24:]).max() < 1e-3


def test_texts_are_scored_and_counts_sent_in_small_parts(monkeypatch):
    from weftview.llm import langid
    from weftview.llm.common import cell_batches, cell_rows

    grams = np.frombuffer(b"abcdbcda", ">u4").astype(np.uint32)
    model = langid.build({"x": (grams, np.ones(2)), "y": (grams[:1], np.ones(1))})
    texts, sizes, totals = ["bcda " * 40] * 2000, [], langid.Model.totals
    want = totals(model, [texts[0].encode()])[0]
    monkeypatch.setattr(langid.Model, "totals", lambda self, data: sizes.append(sum(map(len, data))) or totals(self, data))
    lang, _, bits = langid._identified(model, texts)
    assert max(sizes) <= 1 << 17 and sum(sizes) == 400_000
    assert lang == [["x", "y"][want.argmin()]] * 2000 and bits == [want.min() / 200] * 2000

    cells = np.arange(10_000, dtype=np.uint32)
    parts = list(cell_batches(cells, 64, 16))
    assert max(map(len, parts)) == 16
    whole = cell_rows(cells, 64)
    assert [(c, b) for p in parts for c, b in zip(p["chunk"], p["cells"], strict=True)] == list(zip(whole["chunk"], whole["cells"], strict=True))
