"""The pipeline's stages against brute force on small tables."""

import os

import corpus_pipeline
from weftview.llm import queries
from weftview.llm.packing import _PIECES

EN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the tall dark trees near the river bank today"
DE = "der schnelle braune fuchs springt ueber den faulen hund waehrend sieben weise eulen aus den hohen dunklen baeumen zusehen"
ITEM = "A train with Smith aboard leaves at 9 and covers 120 km before lunch, so how long does it take Smith to reach the old harbour town?"


def _tables(spark, folder):
    rows = [(1, EN, "en", "a"), (2, EN + " again", "en", "a"), (3, DE, "de", "b"), (4, None, "en", "b"), (5, "", "de", "b"), (6, "12 34", "en", "b"),
            (7, "some other words that stand here alone. " + ITEM + " and then the tale goes on with more of the same", "en", "a"),
            (8, "this note keeps a login=someone and password=abcdefgh12345678 for the tall dark trees of the river", "en", "a")]
    docs = [(i, t, lang, source, len(t or ""), i) for i, t, lang, source in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component_id long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    _tables(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(seen["language_id"]) == [1, 2, 3, 7, 8]
    assert sorted(seen["ngram_join"]) == [1, 3, 7, 8]
    assert sorted(seen["decontamination"]) == [1, 3, 8]
    assert seen["secret_scan"][8] == "this note keeps a [secret] and [secret] for the tall dark trees of the river"
    assert seen["secret_scan"][1] == EN
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 3, 8}


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path / "full")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and out.columns == [f.split()[0] for f in _PIECES.split(", ")]


def test_every_operator_is_registered_once():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert names == list(range(1, 11)) and "pipeline" in queries.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert len(corpus_pipeline.STAGES) == 5 and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
