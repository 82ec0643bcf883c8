"""The view store: newest epoch wins, reruns and late epochs, compaction, links in step."""

import random

from pyspark.sql import functions as F

from weftview.sources import view_store as S

VIEWS = "url string, view_id string, content string, seq long, epoch string"


def _df(spark, rows):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], VIEWS)


def _md(n, word="page"):
    return " ".join([word, *(f"[{word} {i}](/t/{i})" for i in range(n))])


def _state(spark, root):
    views = {(r.url, r.view_id): (r.epoch, r.content) for r in S.current(spark, root).collect()}
    links = {}
    for r in S.current(spark, root, "links").collect():
        links.setdefault((r.url, r.view_id), set()).add((r.epoch, r.link_idx, r.target))
    return views, links


def test_newest_epoch_holds_with_its_links(spark, tmp_path):
    root = str(tmp_path / "store")
    first = [("a", "raw", _md(3)), ("a", "summary", _md(1)), ("b", "raw", _md(2)), (None, "raw", "no key"), ("b", None, "no key")]
    second = [("a", "raw", _md(0)), ("c", "raw", None)]
    S.upsert(root, _df(spark, first), 1)
    S.upsert(root, _df(spark, second), 2)
    views, links = _state(spark, root)
    assert views == {("a", "raw"): (2, "page"), ("a", "summary"): (1, _md(1)), ("b", "raw"): (1, _md(2)), ("c", "raw"): (2, None)}
    assert links == {("a", "summary"): {(1, 0, "/t/0")}, ("b", "raw"): {(1, 0, "/t/0"), (1, 1, "/t/1")}}
    counts = {(r.url, r.view_id): r.n_links for r in S.link_counts(spark, root).collect()}
    assert counts == {("a", "raw"): 0, ("a", "summary"): 1, ("b", "raw"): 2, ("c", "raw"): 0}

    before = _state(spark, root)
    S.upsert(root, _df(spark, second), 2)  # run again
    S.upsert(root, _df(spark, [("a", "raw", _md(9)), ("a", "summary", _md(9)), ("b", "raw", _md(9)), ("c", "raw", _md(9))]), 0)  # late
    assert _state(spark, root) == before
    S.compact(spark, root)
    assert _state(spark, root) == before and S._epochs(spark, root) == []
    S.upsert(root, _df(spark, first), 1)  # an epoch in the base once more, and a late one with a new key
    S.upsert(root, _df(spark, [("a", "raw", _md(9)), ("d", "raw", _md(1))]), 0)
    views, links = _state(spark, root)
    assert views.pop(("d", "raw")) == (0, _md(1)) and links.pop(("d", "raw")) == {(0, 0, "/t/0")}
    assert (views, links) == before


def test_duplicates_empty_epochs_and_an_epoch_without_links_yet(spark, tmp_path):
    root = str(tmp_path / "store")
    assert S.current(spark, root).collect() == [] and S.link_counts(spark, root).collect() == []
    S.upsert(root, _df(spark, [("a", "raw", "z old"), ("a", "raw", "a new"), ("a", "raw", "a new")]), 3, order_by="seq")
    S.upsert(root, _df(spark, []), 4)
    assert _state(spark, root) == ({("a", "raw"): (3, "a new")}, {})
    _df(spark, [("a", "raw", "half written")]).select("url", "view_id", "content").write.parquet(f"{root}/views/epoch=5")
    assert _state(spark, root) == ({("a", "raw"): (3, "a new")}, {})  # it counts when its links are there


def test_random_epochs_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    root, want = str(tmp_path / "store"), {}
    order = [3, 0, 5, 1, 5, 2, 4]
    made = {n: [(f"u{rng.randrange(30)}", rng.choice(["raw", "eli5"]), _md(rng.randrange(4), f"e{n}")) for _ in range(40)] for n in set(order)}
    for k, n in enumerate(order):
        S.upsert(root, _df(spark, made[n]), n, order_by="seq")
        for url, view, content in made[n]:
            if n >= want.get((url, view), (-1,))[0]:
                want[url, view] = (n, content)
        if k in (2, 4):
            S.compact(spark, root)
    views, links = _state(spark, root)
    assert views == want
    assert {k: len(v) for k, v in links.items()} == {k: c.count("](") for k, (_, c) in want.items() if "](" in c}
    counts = S.link_counts(spark, root).agg(F.sum("n_links"), F.count("*")).first()
    assert tuple(counts) == (sum(c.count("](") for _, c in want.values()), len(want))
