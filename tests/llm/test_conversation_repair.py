"""Conversation repair: cells against every split and every edit, whole rows against plain Python."""

import hashlib
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftview.llm import conversation_repair as cr
from weftview.llm import queries

CODES = "".join(cr.KINDS)
ROWS = "conv_id long, turn long, role string, text string"


def _all_splits(codes):
    chart = {(i, i + 1): cr.ROWS[c] for i, c in enumerate(codes)}
    for n in range(2, len(codes) + 1):
        for i in range(len(codes) - n + 1):
            tried = {cr.join_cells(chart[i, k], chart[k, i + n]) for k in range(i + 1, i + n)}
            assert len(tried) == 1  # whichever way the span is split
            chart[i, i + n] = tried.pop()
    return chart[0, len(codes)]


@given(st.text(alphabet=CODES, min_size=1, max_size=18))
@settings(max_examples=150, deadline=None)
def test_one_split_a_span_is_enough(codes):
    assert cr.span_cell(codes) == _all_splits(codes)


def _legal(roles):
    body = roles.removeprefix("s")
    return roles == "" or (body and body == "ua" * (len(body) // 2))


def _every_edit(codes):
    """Least (cost, audit) over all ways to edit rows and insert up to two rows in each gap."""
    best = None
    rows = []
    for c in codes:
        kind = next(k for k, x in enumerate(cr.KINDS) if c in x)
        own = cr.INITIALS[cr.KINDS[kind].index(c)]
        rows.append([(4, "D", "")] + ([] if kind == 2 else [(3 * kind, "K", own), (3 + 3 * kind, "R", "u"), (3 + 3 * kind, "R", "a")]))
    gap = [(0, "", ""), (3, "I", "u"), (3, "I", "a"), (6, "II", "ua"), (6, "II", "au")]
    for pick in itertools.product(gap, *itertools.chain(*zip(rows, itertools.repeat(gap)))):
        roles = "".join(p[2] for p in pick)
        if _legal(roles):
            found = (sum(p[0] for p in pick), "".join(p[1] for p in pick))
            best = found if best is None or found < best else best
    return best


def test_cheapest_edits_by_trying_all():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n else 1):
            codes = "".join(rng.choice(CODES) for _ in range(n))
            assert cr.best_audit(cr.span_cell(codes)) == _every_edit(codes), codes


def _brute(rows):
    """The query's rows: a left-to-right search over plain Python rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if f == 1 else "".join(x for x in text if x not in ".!?") if f == 2 else text
            live += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in live:
            end = text.rstrip(cr.SPACE)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        states = {0: (0, "", ())}

        def put(new, state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        def close(states):
            for _ in range(3):
                for s, (cost, audit, lines) in list(states.items()):
                    for role in ("user", "assistant"):
                        if (s, role[0]) in cr.STEP:
                            put(states, cr.STEP[s, role[0]], cost + 3, audit + "I", (*lines, f"{role}:"))
            return states

        close(states)
        for (_, role, text), fault in zip(live, faults, strict=True):
            new = {}
            for s, (cost, audit, lines) in states.items():
                put(new, s, cost + 4, audit + "D", lines)
                if fault not in ("blank", "duplicate"):
                    cost += 3 * (fault == "truncated")
                    for to, more, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if (s, to[:1]) in cr.STEP:
                            put(new, cr.STEP[s, to[:1]], cost + more, audit + edit, (*lines, f"{to}:{text}"))
            states = close(new)
        cost, audit, lines = min(states[s] for s in (0, 3) if s in states)
        turns = [t for t, *_ in live if t is not None]
        pairs = zip([r[1][:1] for r in live], [r[1][:1] for r in live][1:])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit if live else "", hashlib.sha256("\n".join(lines if live else ()).encode()).hexdigest())
    return out


def _made(seed):
    rng = random.Random(seed)
    text = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?", "é. ", "a "]
    role = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "u"]
    rows = [(c, t, rng.choice(role), rng.choice(text)) for c in range(40) for t in range(rng.randrange(9)) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(None, rng.choice([None, 1, 5]), rng.choice(role), rng.choice(text)) for _ in range(9)]
    rows += [(90, None, "user", "Null turn.")] * 2 + [(91, 2, "user", "One.")] + [(92, t, "user" if t % 2 else "system", f"Text {t % 7}.") for t in range(60)]
    rows += [(93, 3, "assistant", "Same.")] * 40 + [(94, 1, "user", "x" * 50_000)] + [(95, 0, "user", None), (95, 20, "assistant", "End.")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def given_rows(spark, tmp_path):
    def write(rows):
        spark.createDataFrame([(*r, "x") for r in rows], ROWS + ", audit string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
        return str(tmp_path)

    return write


@pytest.mark.parametrize("seed", [None, 1])
def test_query_equals_plain_python(spark, given_rows, seed):
    rows = _made(seed) if seed else []
    got = queries.op12_conversation_repair(spark, given_rows(rows))
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in cols) for r in got.collect()} == _brute(rows)


def test_a_conversation_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), rng.choice(["A.", "b", f"{t}.", ""])) for c, n in ((0, 3000), (1, 4)) for t in range(n)]
    df = spark.createDataFrame(rows, ROWS)
    one, many = (sorted(map(tuple, cr.audits(df, ranges=n).collect())) for n in (1, 16))
    assert one == many
    found = cr.audits(df, ranges=16)
    fixed = cr.repaired(df, found).where("conv_id = 0").orderBy("place").collect()
    assert _legal("".join(r.role[0] for r in fixed)) and [r.place for r in fixed] == list(range(len(fixed)))
    assert [r.sha256 is not None for r in fixed] == [False] * (len(fixed) - 1) + [True]
    assert fixed[-1].sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in fixed).encode()).hexdigest()
