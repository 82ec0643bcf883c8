"""Property checks over random inputs, one Spark job each."""

import random
import re

from weftview.operators import chunks as C
from weftview.operators.links import extract_links
from weftview.operators.tokens import tokenize

from conftest import pages_df

PIECES = ["[a](/x)", "[t e x t](https://h.org/p?q=1)", "[](u)", "[t]()", "](", "[", "]", "(", ")",
          "[n [m]](y)", "![img](/i.png)", "[w](<https://w.org>)", "[#](#frag)", "[v](vote?id=2)",
          "[s](from?site=x)", " ", "\n", "word", "ü", "😀", "[ä](/ö)"]


def _random_docs(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_link_spans_are_regex_matches(spark):
    docs = _random_docs(300, 11)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, md string")
    pat = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
    for r in extract_links(df, "doc_id", "md").collect():
        span = docs[r.doc_id][r.start_pos:r.end_pos]
        m = pat.fullmatch(span)
        assert m is not None, (docs[r.doc_id], r)
        assert m.group(1).strip() == r.text


def test_lines_concatenate_to_the_response(spark):
    rnd = random.Random(5)
    rows, full = [], {}
    for conv in range(200):
        parts = ["".join(rnd.choice(["a", "b", "\n", " ", "é"]) for _ in range(rnd.randint(0, 12)))
                 for _ in range(rnd.randint(0, 8))]
        full[conv] = "".join(parts)
        rows += [(conv, i, p if p or rnd.random() < 0.5 else None) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, chunk string")
    got = {}
    for r in C.response_lines(df, ["conv_id"]).orderBy("conv_id", "line_no").collect():
        got.setdefault(r.conv_id, []).append(r.line)
    for conv, text in full.items():
        lines = got.get(conv, [])
        assert "".join(lines) == text
        assert all(line.endswith("\n") for line in lines[:-1])
        assert all("\n" not in line[:-1] for line in lines)


def test_token_lengths_sum_to_html(spark):
    rnd = random.Random(9)
    bits = ["<p>", "</p>", "<a href='x>y'>", "</a>", "<!-- c -->", "<script>if(a<b){}</script>", "text",
            "<", ">", "&amp;", "<br/>", "<div class=\"q\">", "</div>", "<title>t</title>", "  "]
    htmls = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    t = tokenize(pages_df(spark, htmls))
    got = {r.page_id: r.n for r in t.groupBy("page_id").agg({"tok": "collect_list"})
           .selectExpr("page_id", "aggregate(`collect_list(tok)`, 0, (a, x) -> a + length(x)) AS n").collect()}
    for i, h in enumerate(htmls):
        assert got.get(i, 0) == len(h), h
