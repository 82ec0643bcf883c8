"""Charset detection for bodies that are not UTF-8 and whose charset is not declared.

A multi-byte charset is an automaton over bytes, written as a pattern whose groups are the
kinds of its characters; a body it can't read to the end is not in it.  Each kind has a weight (how
much a text in that charset's languages consists of it), and the mean weight over the body's
non-ASCII characters is the charset's score.  Single-byte charsets read every body, so theirs is a
weight of byte pairs: which letters stand next to each other.  The best score above 0 wins;
otherwise the body is ISO-8859-1.  A character that the body's end cuts is no fault.  Bodies are
looked at as wholes, in linear time.
"""

from __future__ import annotations

import re

# --- fixed values: kinds of two-byte characters by lead and trail byte, and their weights ------
# (code chart rows: kana, punctuation, the frequent half of the ideographs, Hangul, the rest)
_T = rb"[\xa1-\xfe]"
_SJ = rb"[\x40-\x7e\x80-\xfc]"
_B5 = rb"[\x40-\x7e\xa1-\xfe]"
_GB = rb"[\x40-\x7e\x80-\xfe]"
MULTI_BYTE = {
    "shift_jis": [(rb"\x82[\x9f-\xf1]|\x83[\x40-\x96]", 1.0), (rb"\x81" + _SJ + rb"|\x82" + _SJ, 0.3), (rb"[\x88-\x97]" + _SJ, 0.6),
                  (rb"[\xa1-\xdf]", -0.6), (rb"[\x81-\x9f\xe0-\xfc]" + _SJ, -1.0)],
    "euc_jp": [(rb"\xa4[\xa1-\xf3]|\xa5[\xa1-\xf6]", 1.0), (rb"[\xa1-\xa3]" + _T, 0.3), (rb"[\xb0-\xcf]" + _T, 0.5),
               (rb"\x8e[\xa1-\xdf]|\x8f" + _T + _T + rb"|[\xa6-\xfe]" + _T, -1.0)],
    "gbk": [(rb"[\xb0-\xd7]" + _T, 0.7), (rb"[\xa1-\xa3]" + _T, 0.3), (rb"[\xd8-\xf7]" + _T, 0.0), (rb"[\x81-\xfe]" + _GB, -1.0)],
    "big5": [(rb"[\xa4-\xc6]" + _B5, 0.65), (rb"[\xa1-\xa3]" + _B5, 0.3), (rb"[\xc9-\xf9]" + _B5, -0.3)],
    "euc_kr": [(rb"[\xb0-\xc8]" + _T, 0.9), (rb"[\xa1-\xa3]" + _T, 0.3), (rb"[\xa4-\xfe]" + _T, -1.0)],
}
_AUTOMATA = {name: (re.compile(b"[\x00-\x7f]+|" + b"|".join(b"(" + p + b")" for p, _ in kinds)), [w for _, w in kinds])
             for name, kinds in MULTI_BYTE.items()}

# --- fixed values: letters of Russian text, from frequent to seldom; single-byte Cyrillic charsets ---
FREQUENT, SELDOM = "оеаинтсрвлкмдпу", "щэъфцёЪЫЬ"
CYRILLIC = ("windows-1251", "koi8_r", "iso8859_5")

_HIGH = re.compile(rb"[\x80-\xff]+")


def _multi_byte(body: bytes, name: str) -> float | None:
    """Mean weight of the body's non-ASCII characters; None if the charset can't read it."""
    automaton, weights = _AUTOMATA[name]
    at, total, n = 0, 0.0, 0
    for m in automaton.finditer(body):
        if m.start() != at:
            return None
        at = m.end()
        if m.lastindex:
            total += weights[m.lastindex - 1]
            n += 1
    return total / n if n and at >= len(body) - 1 else None


def _cyrillic(runs: list[tuple[bytes, bool]], name: str) -> float:
    """Mean over the high bytes: frequent small letters count for the charset; a capital behind a small
    letter, signs inside words and letters next to ASCII letters count against it."""
    total = n = 0
    for run, touches in runs:
        text, small = run.decode(name, "replace"), False
        for c in text:
            n += 1
            if not "Ѐ" <= c <= "ӿ":
                total -= 0.7
            elif c.isupper() and small or c in SELDOM:
                total -= 0.6
            elif not c.isupper():
                total += 1.0 if c in FREQUENT else 0.3
            small = c.islower()
        total -= len(text) * 1.0 * touches
    return total / n


def _latin(runs: list[tuple[bytes, bool]]) -> float:
    """Mean over the high bytes: an accented letter by itself among ASCII letters counts for Western
    text, high bytes in a row against it."""
    total = n = 0
    for run, touches in runs:
        letters = sum(b >= 0xC0 and b not in (0xD7, 0xF7) for b in run)
        n += len(run)
        total += (0.9 if touches or letters < len(run) else 0.3) * len(run) if len(run) == 1 else (0.1 if touches else -0.4) * len(run)
    return total / n


def detect(body: bytes) -> str:
    """The codec name for a body that is not UTF-8."""
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    runs = []
    for m in _HIGH.finditer(body):
        near = body[max(m.start() - 1, 0):m.start()] + body[m.end():m.end() + 1]
        runs.append((m.group(), any(bytes([b]).isalpha() for b in near)))
    if not runs:
        return "iso-8859-1"
    scores = {name: s for name in MULTI_BYTE if (s := _multi_byte(body, name)) is not None}
    scores |= {name: _cyrillic(runs, name) for name in CYRILLIC}
    scores["latin"] = _latin(runs)
    best = max(scores, key=scores.get)
    if scores[best] > 0 and best != "latin":
        return "gb18030" if best == "gbk" else "cp932" if best == "shift_jis" else best
    smart = re.search(rb"[\x80-\x9f]", body) and not re.search(rb"[\x81\x8d\x8f\x90\x9d]", body)
    return "windows-1252" if smart else "iso-8859-1"


def detected_text(body: bytes) -> str:
    return body.decode(detect(body), "replace")
