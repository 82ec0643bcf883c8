"""Links and URLs."""

import itertools
from urllib.parse import urljoin

from pyspark.sql import functions as F

from weftview.functions.urls import default_scheme, link_class, resolve_url
from weftview.operators.links import extract_links, highlight, link_ring


DOCS = [
    "Go [home](https://a.com) or [root](/r) [frag](#x) [v](vote?id=1) [s](from?site=z) [w](< https://w.org >)",
    "[](empty) [t]() [a] (b) [nested [x]](y) [two](u1)[lines\nhere](u2) ünï [ćode](/ü)",
    "[  spaced text  ](  /p  ) tail",
    "no links at all",
    "".join(f"[l{i}](/p{i}) " for i in range(1000)),
]


def _numbered_span(i):
    """Where link i of the last document stands (a space follows each link)."""
    width = lambda k: 7 + 2 * len(str(k))  # noqa: E731 - "[l" "](/p" ")" and both numbers
    start = sum(width(k) + 1 for k in range(i))
    return start, start + width(i)


# (text, target, start, end) of the links to be found, by document
LINKS = [
    [("home", "https://a.com", 3, 24), ("root", "/r", 28, 38), ("w", " https://w.org ", 82, 104)],
    [("two", "u1", 40, 49), ("lines\nhere", "u2", 49, 65), ("ćode", "/ü", 70, 80)],
    [("spaced text", "/p", 0, 25)],
    [],
    [(f"l{i}", f"/p{i}", *_numbered_span(i)) for i in range(1000)],
]


def test_extraction_matches_python(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, md string")
    got = {}
    for r in extract_links(df, "doc_id", "md").orderBy("doc_id", "link_idx").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.target, r.start_pos, r.end_pos))
    for i, d in enumerate(DOCS):
        assert got.get(i, []) == LINKS[i], i
    assert len(got[4]) == 1000


BASES = ["https://example.com/a/b/c.html?q=1#f", "http://h.org", "https://h.org/dir/", "https://h.org/x//y/z", "HTTP://Up.org/dir/x"]
TARGETS = ["/p", "p", "../p", "../../../p", "./p/./q", "p/..", "?k=v", "#frag", "", "//other.org/z",
           "mailto:a@b.c", "javascript:void(0)", "a//b/../c", "/a/../b/.", "https://abs.org/x",
           "http://abs.org/y", "p?x=1#y", "..", ".",
           "https:c", "HTTPS:c?d", "http:c", "HTTPS://Up.org/y", "https:", "https:/r", "https://", "a:b"]


def test_resolve_matches_urljoin(spark):
    pairs = list(itertools.product(BASES, TARGETS))
    df = spark.createDataFrame(pairs, "base string, target string")
    got = [r[0] for r in df.select(resolve_url(F.col("target"), F.col("base"))).collect()]
    want = [t if t.startswith(("http://", "https://")) else urljoin(b, t) for b, t in pairs]
    assert got == want


def test_resolve_without_base_and_classes(spark):
    rows = [("/p", None), ("p.html", None), ("mailto:a@b", None), ("javascript:x", None),
            ("mailto:a@b", "https://h.org/"), ("javascript:x", "https://h.org/"), ("https://x.org", None)]
    df = spark.createDataFrame(rows, "target string, base string")
    r = df.select(resolve_url(F.col("target"), F.col("base")).alias("u"))
    out = [(x.u, x.c) for x in r.select("u", link_class(F.col("u")).alias("c")).collect()]
    assert out == [("https://example.com/p", "navigate"), ("https://p.html", "navigate"),
                   ("https://mailto:a@b", "navigate"), ("https://javascript:x", "navigate"),
                   ("mailto:a@b", "mailto"), ("javascript:x", "javascript"),
                   ("https://x.org", "navigate")]


def test_highlight_of_any_link(spark):
    from weftview.operators.links import highlight_nth

    md = "a [x](/1) b [skip](#f) c [y]( </2> ) d [z](/3)"
    df = spark.createDataFrame([(k, m) for m in (md, "none", "", None) for k in range(-1, 5)], "k int, md string")
    got = [(r.k, r.md, r.out) for r in df.withColumn("out", highlight_nth(F.col("md"), F.col("k"))).collect()]
    want = {0: md.replace("[x](/1)", "**→ [x](/1) ←**"), 1: md.replace("[y]( </2> )", "**→ [y](/2) ←**"), 2: md.replace("[z](/3)", "**→ [z](/3) ←**")}
    assert all(out == (want.get(k, m) if m == md else m) for k, m, out in got)


def test_default_scheme(spark):
    rows = ["example.com", "example.com/path?q=1", "http://a.org", "https://b.org", "  c.org  ", "", "   "]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    got = [r[0] for r in df.select(default_scheme(F.col("u"))).collect()]
    assert got == ["https://example.com", "https://example.com/path?q=1", "http://a.org",
                   "https://b.org", "https://c.org", None, None]


def test_ring_and_highlight(spark):
    md = "a [one](/1) b [two](/2) c"
    df = spark.createDataFrame([(0, md)], "doc_id long, md string")
    links = extract_links(df, "doc_id", "md")
    ring = {r.cur_idx: (r.next_idx, r.prev_idx) for r in link_ring(links, "doc_id").collect()}
    assert ring == {-1: (0, 0), 0: (1, 1), 1: (0, 0)}
    first = links.where("link_idx = 0").join(df, "doc_id")
    h = first.select(highlight(F.col("md"), F.col("text"), F.col("target"), F.col("start_pos"),
                               F.col("end_pos"))).first()[0]
    assert h == "a **→ [one](/1) ←** b [two](/2) c"
    three = spark.createDataFrame([(0, "[a](/a)[b](/b)[c](/c)")], "doc_id long, md string")
    r3 = {r.cur_idx: r.prev_idx for r in link_ring(extract_links(three, "doc_id", "md"), "doc_id").collect()}
    assert r3[-1] == 1  # previous from "nothing selected" is n-2, as in the reference
