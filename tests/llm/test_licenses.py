"""License scan: base phrases against plain Python, templates by hand, planted notices, hostile texts."""

import random
import re
import time

from weftview.llm import licenses

DOC = "doc_id long, text string"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def _scan(spark, texts):
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], DOC + ", score double, labels string").repartition(3)
    return {r.doc_id: r for r in licenses.scanned(docs).collect()}


def _base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    ends = (min(found)[0], max(found)[0]) if found else (None, None)
    return len(words), len(found), *ends, ",".join(sorted({x for _, x in found}))


def test_base_equals_plain_python(spark):
    rng = random.Random(2)
    parts = ["MIT", "License", "license", "apache", "General", "PUBLIC", "é", "İ", "K", "x1", "mit-license", "MIT\tLicense", "", "\x00", "{", "日本", "public license"]
    texts = [rng.choice([" ", ", ", "\n", ""]).join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += [None, "", "mit license " * 5000, "word " * 100_000 + "Apache License", "MIT licensed", "mit. LICENSE", texts[0]]
    got = _scan(spark, texts)
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == _base(t), t
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1


def test_every_template_is_found_in_prose_and_changed_ones_are(spark):
    filler = "some prose that is of no interest and says nothing at all about software. " * 4
    whole = [f"{filler} {text}. {filler}" for _, text, _ in licenses.TEMPLATES]
    # a comment marker on each line and one word more, far from the mandatory phrases
    noisy = [f"{filler}\n# {text.replace(', ', ', # ')} {filler}" for _, text, _ in licenses.TEMPLATES]
    got = _scan(spark, whole + noisy)
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert label in got[i + len(whole)].labels.split(",")


def test_words_out_of_place_are_no_notice(spark):
    mit = licenses.TEMPLATES[0][1].split()
    rng = random.Random(4)
    mixed = mit[:]
    rng.shuffle(mixed)
    without = licenses.TEMPLATES[0][1].replace("free of charge", "for some charge")
    spread = " ".join(w + " filler" * 9 for w in mit)
    typo = licenses.TEMPLATES[0][1].replace("obtaining", "getting").replace("limitation", "limits")
    got = _scan(spark, [" ".join(mixed), without, spread, typo, "the mit and its license", "by cc nc 4.0 licensed", "SPDX-License-Identifier: MIT"])
    assert [got[i].labels for i in range(7)] == ["", "", "", "mit", "", "", "mit"]
    assert 0.75 <= got[3].score < 1 and got[6].n_base == 0


def test_one_text_in_many_languages_and_labels(spark):
    text = "Licensed under CC BY-NC 4.0. é Released under the MIT License; some say it is licensed under the GNU General Public License, version 3."
    got = _scan(spark, [text])[0]
    assert got.labels == "cc-by-nc,gpl,gpl-3,mit" and got.base_labels == "gpl,mit" and got.n_base == 2


def test_hostile_texts_take_little_time(spark):
    ix = licenses.index()
    texts = ["license " * 125_000, "mit license general public apache " * 30_000, "cc by " * 170_000, "a" * 1_000_000]
    began = time.time()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)
    assert licenses.scanned(docs, ix).count() == 4
    assert time.time() - began < 60


def test_empty_table_and_counts_over_all_documents(spark):
    assert licenses.scanned(spark.createDataFrame([], DOC)).collect() == []
    ix = licenses.index()
    held, n = licenses.holders(spark.createDataFrame([(1, "MIT mit"), (2, None), (None, "mit license"), (2, None)], DOC), ix)
    assert n == 4 and held[ix.words.index(b"mit")] == 2 and held[ix.words.index(b"license")] == 1 and held.sum() == 3
