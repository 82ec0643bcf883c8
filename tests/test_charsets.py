"""Charset detection: undeclared bodies in several charsets, made from the texts of the given tables."""

import random
import time

import pytest

from conftest import SF
from weftview.sources import charsets
from weftview.sources.responses import load_pages

LATIN = "abcdefghijklmnopqrstuvwxyzéèàçêäöüß"
CYRILLIC = "абцдефгхийклмнопярстувшхызэечеаоуснои"
HIRAGANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"
KANJI = "日本人大年会国時出行見月後前生五間上東四今金九入学高円子外八六下来気小七山話女北午百書先名川千水半男西電校語土木聞食車何南万毎白天母火右読友左休父雨"


def _cyrillic(text):
    """Each Latin letter as a Cyrillic one, capitals as capitals."""
    small = {c: CYRILLIC[i] for i, c in enumerate(LATIN)}
    return "".join(small.get(c) or (small[c.lower()].upper() if c.lower() in small else c) for c in text)


def _japanese(text):
    """Words as kana after their letters, some with an ideograph."""
    rng = random.Random(text)
    return "".join(("" if rng.random() < 0.6 else rng.choice(KANJI)) + "".join(HIRAGANA[ord(c) % len(HIRAGANA)] for c in w) + ("。" if w[-1] in ".," else "") for w in text.split())


def _ideographs(text, codec, low, high, sep):
    """Words as characters of the code chart's frequent rows."""
    rng = random.Random(text)
    return sep.join("".join(bytes([rng.randint(low, high), rng.randint(0xA1, 0xFD)]).decode(codec, "ignore") for _ in w[:5]) for w in text.split())


MADE = {
    "iso-8859-1": (lambda t: t, "latin-1", 0.97),
    "windows-1251": (_cyrillic, "windows-1251", 0.9),
    "koi8_r": (_cyrillic, "koi8_r", 0.9),
    "iso8859_5": (_cyrillic, "iso8859_5", 0.9),
    "cp932": (_japanese, "cp932", 0.97),
    "euc_jp": (_japanese, "euc_jp", 0.97),
    "gb18030": (lambda t: _ideographs(t, "gb2312", 0xB0, 0xD6, "\uff0c"), "gb18030", 0.97),
    "euc_kr": (lambda t: _ideographs(t, "euc_kr", 0xB0, 0xC8, " "), "euc_kr", 0.97),
    "big5": (lambda t: _ideographs(t, "big5", 0xA4, 0xC5, "\uff0c"), "big5", 0.97),
}


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 40]


@pytest.mark.parametrize("name", MADE)
def test_hit_rate(texts, name):
    make, codec, least = MADE[name]
    found = []
    for t in texts:
        body = ("<html><body><p>" + make(t) + "</p></body></html>").encode(codec, "ignore")
        try:
            body.decode("utf-8")
        except UnicodeDecodeError:
            found.append(charsets.detect(body))
    assert len(found) >= 30 and sum(x.replace("windows-1252", "iso-8859-1") == name for x in found) >= least * len(found)


def test_undeclared_bodies_are_read(spark):
    ru, jp = "Это обычный русский текст, и он читается без объявления.", "これは日本語の文章です。"
    rows = [("ru", 200, None, ru.encode("windows-1251")), ("koi", 200, "ISO-8859-1", ru.encode("koi8_r")), ("jp", 200, "", jp.encode("shift_jis")),
            ("cut", 200, None, jp.encode("euc_jp")[:-1]), ("unknown", 200, "x-none", jp.encode("euc_jp")), ("quote", 200, None, b"\x93caf\xe9\x94"),
            ("bom", 200, None, "a\u65e5".encode("utf-16")), ("utf8", 200, None, jp.encode()), ("ascii", 200, "ascii", b"plain"), ("none", 200, None, None)]
    df = spark.createDataFrame(rows, "url string, status int, charset string, body binary")
    got = {r.url: r.html for r in load_pages(df).collect()}
    assert got == {"ru": ru, "koi": ru, "jp": jp, "cut": jp[:-1] + "\ufffd", "unknown": jp, "quote": "\u201ccafé\u201d", "bom": "a\u65e5",
                   "utf8": jp, "ascii": "plain", "none": None}


def test_long_and_hostile_bodies_take_linear_time():
    began = time.time()
    for body in (b"\xe9" * 1_000_000, b"\x81" * 1_000_000, b"a\xe9" * 500_000, b"\xa4\xa2" * 500_000, bytes(range(256)) * 4000):
        assert isinstance(charsets.detected_text(body), str)
    assert time.time() - began < 30


def test_bodies_go_to_python_in_small_batches(spark):
    from weftview.plans.render import page_errors

    plan = page_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
