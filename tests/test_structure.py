"""Tokens, scopes, titles, main content and noise removal."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import pages_df
from weftview.operators.content import page_structure, page_title_agg
from weftview.operators.tokens import elements, tokenize

ARTICLE = "<p>" + ("word " * 150) + "</p>"


def _structure(spark, htmls):
    return page_structure(tokenize(pages_df(spark, htmls)))


def _titles(spark, htmls):
    st = _structure(spark, htmls)
    rows = st.groupBy("page_id").agg(page_title_agg().alias("t")).collect()
    return {r.page_id: r.t for r in rows}


def test_tokens_are_lossless_on_hostile_input(spark):
    attrs = " ".join(f'a{i}="v{i}"' for i in range(20000))
    htmls = [
        f"<div {attrs}>x</div>",
        "<p>" + "y" * 1_048_576 + "</p>",
        '<a title="unclosed>quote">t</a><script>var t="</p>";</script>',
        "",
        "  \t\n ",
        "<html><body></body></html>",
    ]
    t = tokenize(pages_df(spark, htmls))
    got = {r.page_id: r.n for r in t.groupBy("page_id").agg(F.sum(F.length("tok")).alias("n")).collect()}
    for i, h in enumerate(htmls):
        assert got.get(i, 0) == len(h)
    script = t.where((F.col("page_id") == 2) & (F.col("tag") == "script")).collect()
    assert len(script) == 1 and script[0].kind == "raw"


def test_titles_including_missing_and_unclosed(spark):
    htmls = [
        "<html><head><title> Test Page </title></head><body><p>x</p></body></html>",
        "<html><body><p>no title</p></body></html>",
        "<html><head><title>Unclosed<p>Malformed",
        "<head><title>Only Head</title></head>",
        "",
    ]
    t = _titles(spark, htmls)
    assert t[0] == "Test Page"
    assert t[1] == "No Title"
    assert t[2] == "Unclosed"
    assert t[3] == "Only Head"
    assert 4 not in t  # no tokens: callers coalesce to "No Title"


def test_scopes_survive_unclosed_and_stray_tags(spark):
    html = "</div><div><p><b>a<p>b<article>" + ARTICLE + "</article></div></div>"
    e = elements(tokenize(pages_df(spark, [html])))
    art = e.where((F.col("tag") == "article") & (F.col("sign") == 1)).collect()[0]
    closes = e.where((F.col("tag") == "article") & (F.col("sign") == -1)).collect()
    assert art.close_pos == closes[0].pos
    assert art.elem_len == len(("word " * 150).strip())


def test_main_content_priority_and_threshold(spark):
    short_main = "<main><p>short</p></main>"
    long_art = "<article>" + ARTICLE + "</article>"
    longer_div = '<div class="content">' + ARTICLE + ARTICLE + "</div>"
    htmls = [
        short_main + long_art,           # main too short -> article wins
        long_art + longer_div,           # article ranks before .content
        "<div>" + ARTICLE + "</div>",    # nothing qualifies -> whole page
        '<div itemtype="https://schema.org/Recipe">' + ARTICLE + "</div>",
    ]
    st = _structure(spark, htmls)
    got = {r.page_id: r.t for r in st.groupBy("page_id").agg(F.max("main_tag").alias("t")).collect()}
    assert got == {0: "article", 1: "article", 2: None, 3: "div"}


def test_noise_removed_inside_main_and_whole_page(spark):
    inner = ('<article><script>evil()</script><div class="ads">buy</div>' + ARTICLE
             + '<div aria-hidden="true">hidden</div></article>')
    whole = ("<nav><a href='/x'>menu</a></nav><div class='ad'>kept ad</div><p>body text</p>"
             "<footer>foot</footer><style>p{}</style>")
    st = _structure(spark, [inner, whole])
    kept = {}
    for r in st.where("keep AND kind = 'text'").collect():
        kept.setdefault(r.page_id, []).append(r.text)
    text0 = " ".join(kept[0])
    assert "buy" not in text0 and "hidden" not in text0 and "evil" not in text0
    assert "word" in text0
    text1 = " ".join(kept[1])
    assert "menu" not in text1 and "foot" not in text1
    assert "kept ad" in text1 and "body text" in text1


def test_deep_nesting(spark):
    html = "<div>" * 100 + "deep" + "</div>" * 100
    nested = "".join("<div><span><p>" for _ in range(50)) + "inner" + "".join(
        "</p></span></div>" for _ in range(50))
    st = _structure(spark, [html, nested])
    texts = {r.page_id: r.text for r in st.where("keep AND kind = 'text'").collect()}
    assert texts == {0: "deep", 1: "inner"}


def test_table_rows_rules(spark):
    from weftview.operators.tables import table_rows

    html = ("<table>"
            "<tr><th>Name</th><th>Qty</th><th>Notes here</th></tr>"              # Qty is 3 chars -> kept
            "<tr><td><a href='/item/1'>Long link</a> <a href='#x'>Anchor text</a>"
            " <a href='/s'>abc</a></td><td>ok</td><td>plain cell</td></tr>"      # 'ok' too short
            "<tr><td>tiny</td><td>x</td></tr>"                                   # row 'tiny' too short
            "<tr><td><a href=''>Empty href</a></td><td>"
            "<table><tr><td>inner cell text</td></tr></table></td></tr>"
            "</table>")
    rows = [r.text for r in table_rows(pages_df(spark, [html])).orderBy("row_pos").collect()]
    # 'abc' and 'ok' are too short; the last row holds its nested table's cell as well.
    assert rows == ["Name | Qty | Notes here",
                    "[Long link](/item/1) | Anchor text | plain cell",
                    "Empty href | inner cell text | inner cell text",
                    "inner cell text"]


class _Tree(HTMLParser):
    """Rows of nested tables from well-formed HTML, by walking a tree."""

    def __init__(self, html):
        super().__init__()
        self.root = ["root", {}, [], None]
        self.at = self.root
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], self.at]
        self.at[2].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[2].append(data)

    def all(self, node, *tags):
        for x in node[2]:
            if not isinstance(x, str):
                if x[0] in tags:
                    yield x
                yield from self.all(x, *tags)

    def text(self, node):
        return "".join(x if isinstance(x, str) else self.text(x) for x in node[2])

    def rows(self):
        out = []
        for row in [r for t in self.all(self.root, "table") for r in self.all(t, "tr") if t is next(self.all(self.root, "table"))]:
            items = []
            for cell in self.all(row, "td", "th"):
                links = list(self.all(cell, "a"))
                for x in links or [cell]:
                    text, href = self.text(x).strip(), x[1].get("href") or ""
                    if len(text) > (3 if links else 2):
                        items.append(f"[{text}]({href})" if links and href and not href.startswith("#") else text)
            line = " | ".join(items)
            if len(line) > 10:
                out.append(line)
        return out


def test_nested_rows_equal_a_walk_of_the_tree(spark):
    from weftview.operators.tables import table_rows

    rng = random.Random(8)

    def cell(depth):
        kind = rng.random()
        if depth < 4 and kind < 0.35:
            return f"<td>{rng.choice(['', 'before '])}{made(depth + 1)}{rng.choice(['', ' after', '<a href="/x">next page</a>'])}</td>"
        if kind < 0.6:
            return f"<td><b>x</b><a href='{rng.choice(['/p', '#top', ''])}'>{rng.choice(['abc', 'long link'])}</a> tail</td>"
        tag = rng.choice(["td", "th"])
        return f"<{tag}>{rng.choice(['', 'ab', 'plain <i>cell</i> text', 'abc'])}</{tag}>"

    def made(depth=0):
        return "<table>" + "".join("<tr>" + "".join(cell(depth) for _ in range(rng.randint(0, 3))) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"

    pages = [f"<div>{made()}</div>" for _ in range(30)] + ["<table>" * 30 + "<tr><td>deep down here</td></tr>" + "</table>" * 30, "<tr><td>no table around it</td></tr>", "", None]
    got = {}
    for r in table_rows(pages_df(spark, pages)).orderBy("page_id", "row_pos").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {i: rows for i, p in enumerate(pages) if p and (rows := _Tree(p).rows())} and len(got) > 20


def test_table_rows_read_each_token_once(spark):
    # no window over the tokens and no row for each level a token is nested at: a row a token, then a row a page
    from weftview.operators.tables import table_rows

    plan = table_rows(pages_df(spark, ["<table>"]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Generate ") == 1 and len(re.findall(r"Exchange ", plan)) == 1


def test_table_rows_of_repeated_and_null_page_ids(spark):
    from weftview.operators.tables import table_rows

    html = "<table><tr><td>first cell</td><td><a href=/x>some link</a></td></tr></table>"
    df = spark.createDataFrame([(1, html), (None, html), (2, html), (2, html)], "page_id long, html string")
    got = {(r.page_id, r.row_pos): r.text for r in table_rows(df).collect()}
    one, link = "first cell | [some link](/x)", "[" + 4 * "some link" + "](/x)"
    assert got[1, 1] == got[None, 1] == one
    # copies of a page are one page: a token of each is in the elements of both
    assert set(got) == {(1, 1), (None, 1), (2, 1)} and link in got[2, 1]


def test_token_kinds_and_names_are_those_of_the_rules(spark):
    from weftview.functions.patterns import RAW_RE, SELF_CLOSING_RE, VOID_TAGS

    toks = ["<td>", "</td>", "<TD>", "</Td >", "<td/>", "<td />", "<td<>", "<a/href=x>", "<p\t>", "<p\x0b>", "<p\x85>", "<br>", "<br/>", "<h1>",
            "<tables>", "<script-x>", "<SCRIPT>", "<scripty>", "<title>", "<İx y>", "<İ>", "<img src=a/>", '<img src="a"/>', "</3>", "<!x>", "<?x>", "<!-- x -->", "<p"]
    rows = tokenize(pages_df(spark, toks)).where("pos = 0").select("tok", "kind", "tag", "sign", "attrs").collect()
    for r in rows:
        start = re.match("<[A-Za-z]", r.tok)
        kind = ("comment" if r.tok.startswith("<!--") else "raw" if re.match(RAW_RE, r.tok, re.A) else "end" if re.match("</[A-Za-z]", r.tok)
                else "start" if start else "decl" if re.match("<[!?/]", r.tok) else "text")
        name = re.match(r"</?([A-Za-z][^\s/>]*)", r.tok, re.A)
        tag = name[1].lower() if kind in ("start", "end", "raw") else None
        sign = 0 if tag in VOID_TAGS else {"start": 0 if re.search(SELF_CLOSING_RE, r.tok, re.A) else 1, "end": -1}.get(kind, 0)
        assert (r.kind, r.tag, r.sign) == (kind, tag, sign), r
        assert (r.attrs is None) == (kind != "start")
    assert len(rows) >= len(toks) - 1


def test_response_decoding(spark):
    from weftview.sources.responses import load_pages

    rows = [
        ("u1", 200, None, "café".encode("utf-8")),          # no charset: valid UTF-8
        ("u2", 200, "ISO-8859-1", "café".encode("latin-1")),  # suspect charset, not UTF-8
        ("u3", 200, "utf-8", b"caf\xe9"),                    # declared UTF-8, bad byte
        ("u4", 200, "windows-1252", b"a\x93b\x94"),          # any other charset: its codec
        ("u8", 200, "Shift_JIS", "日本".encode("shift_jis") + b"\x81"),  # bad end replaced
        ("u9", 200, "x-unknown", "café".encode("latin-1")),  # no such codec: as not declared
        ("u5", 404, "utf-8", b"<p>gone</p>"),                # error status
        ("u6", 200, "ascii", None),                          # no body
        ("u7", 200, " UTF-8 ", b""),                         # empty page
    ]
    df = spark.createDataFrame(rows, "url string, status int, charset string, body binary")
    got = {r.url: (r.ok, r.html, r.reason, r.message) for r in load_pages(df).collect()}
    assert got["u1"][:2] == (True, "café")
    assert got["u2"][:2] == (True, "café")
    assert got["u3"][:2] == (True, "caf�")
    assert got["u4"][:2] == (True, "a“b”")
    assert got["u8"][:2] == (True, "日本�")
    assert got["u9"][:2] == (True, "café")
    assert got["u5"][:3] == (False, None, "HTTP 404")
    assert got["u6"][:3] == (False, None, "no response")
    assert got["u7"][:3] == (False, None, "empty page")


def test_page_partitions_fixed_and_overridable(spark):
    from weftview.operators.tokens import PAGE_PARTITIONS_CONF, page_partitions

    p = pages_df(spark, ["<p>a</p>", "<p>b</p>"])
    default = page_partitions(p)
    assert default >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(PAGE_PARTITIONS_CONF, "5")
    try:
        plan = tokenize(p)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(page_id" in plan and ", 5)" in plan and "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.unset(PAGE_PARTITIONS_CONF)


def test_page_partitions_grow_with_the_html(spark, monkeypatch):
    from weftview.operators import tables, tokens

    pages = pages_df(spark, ["<table><tr><td>first cell</td><td>é second</td></tr></table>"] * 50 + ["", None])
    want = {(r.page_id, r.text) for r in tables.table_rows(pages).collect()}
    monkeypatch.setattr(tokens, "PARTITION_BYTES", 64)  # less than a page
    n = tokens.page_partitions(pages)
    assert n == -(-50 * 61 // 64) and ", %d)" % n in tables.table_rows(pages)._jdf.queryExecution().executedPlan().toString()
    assert {(r.page_id, r.text) for r in tables.table_rows(pages).collect()} == want == {(i, "first cell | é second") for i in range(50)}


def test_title_lookup_after_noise_removal_only_in_whole_page_branch(spark):
    # No main content -> the title inside <nav> (noise) is skipped;
    # with main content the first <title> anywhere wins.
    whole = "<nav><title>In nav</title></nav><p>body</p><title>Outside</title>"
    with_main = "<nav><title>In nav</title></nav><article>" + ARTICLE + "</article>"
    t = _titles(spark, [whole, with_main])
    assert t == {0: "Outside", 1: "In nav"}


def test_noise_counts_towards_main_threshold(spark):
    # 450 chars of prose + 100 chars inside an ad block = 550 > 500, so the
    # article is the main content; the ad is then removed from it.
    prose = "<p>" + "x" * 450 + "</p>"
    ad = '<div class="ads">' + "y" * 100 + "</div>"
    st = _structure(spark, ["<article>" + prose + ad + "</article>"])
    assert st.agg(F.max("main_tag")).first()[0] == "article"
    kept = "".join(r.text for r in st.where("keep AND kind = 'text'").collect())
    assert "x" * 450 in kept and "y" not in kept
