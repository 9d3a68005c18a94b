"""Briefs made by rule against plain loops."""

from __future__ import annotations

import json
import math
import random
import re

import pytest

from loglathe.operators import cuts

ROWS = "session int, idx int, role string, text string, nbytes long, terminal boolean"
FOLDS = "session int, fold string, kind string, parent string, start int, end int, nbytes long"


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh0") for _ in range(draw.randint(2, 9))) for _ in range(60)]
    text = lambda: "".join(" ".join(draw.choice(words) for _ in range(draw.randint(2, 14))) + draw.choice([". ", "! ", "?\n", "\n\n", ".\n", " "]) for _ in range(draw.randint(0, 12)))
    return [(s, i, "user" if i % 2 == 0 else "assistant", text(), 1, True) for s in (1, 2) for i in range(30)]


def kept_in_order(pieces, cap):
    out, used = [], 0
    for p in filter(None, (x.strip() for x in pieces)):
        if used + len(p) + 1 > cap:
            return "\n".join(out) if out else p[:cap]
        out.append(p)
        used += len(p) + 1
    return "\n".join(out)


def rarest(texts, every, cap):
    tokens = lambda x: re.findall("[a-z0-9_./-]{3,}", x.lower())
    sentences = [x.strip() for t in texts for x in re.split(r"(?<=[.!?])\s+|\n+", t)]
    found = []
    for i, x in enumerate(sentences):
        if 20 <= len(x) <= 400 and tokens(x):
            found.append((-round(sum(math.log(len(every) / (1 + sum(t in tokens(y) for y in every))) for t in tokens(x)) / len(tokens(x)), 6), i, x))
    out, used = [], 0
    for _, i, x in sorted(found):
        if used + len(x) + 1 <= cap:
            out.append((i, x))
            used += len(x) + 1
    return "\n".join(x for _, x in sorted(out))


@pytest.mark.parametrize("cap", [30, 300, 2000])
def test_cuts_equal_plain_loops(spark, prose, cap):
    folds = [(1, "a", "all", None, 0, 30, 0), (2, "b", "all", None, 3, 9, 0), (2, "c", "all", None, 20, 20, 0)]
    got = {(r.fold, r.way): r.brief for r in cuts.all_cuts(spark.createDataFrame(prose, ROWS), spark.createDataFrame(folds, FOLDS), cap).collect()}
    for s, fold, _, _, a, b, _ in folds:
        own = [(role, text) for t, i, role, text, *_ in prose if t == s and a <= i < b]
        paragraphs = [[p for p in (q.strip() for q in re.split(r"\n{2,}", text)) if p] for _, text in own]
        data = r"\b(?=\w*\d)[\w./-]{4,}\b|\b\d{2,}\b"
        expected = {
            "assistant notes": kept_in_order([t.strip()[:160] for r, t in own if r == "assistant"], cap),
            "data lines": kept_in_order([x.strip() for _, t in own for x in t.split("\n") if len(x.strip()) <= 300 and re.search(data, x.strip())], cap),
            "head and tail": kept_in_order([x for p in paragraphs for x in ([p[0], p[-1]] if len(p) > 1 else p)], cap),
            "last assistant": next((t.strip()[:cap] for r, t in reversed(own) if r == "assistant" and t.strip()), ""),
            "salience": rarest([t for _, t in own], [t for q, _, _, t, *_ in prose if q == s], cap),
        }
        assert {w: got[fold, w] for w in expected} == expected


def test_consolidation_brief_shares_what_short_subjects_leave(spark):
    m = [(1, i, "user" if i % 2 == 0 else "assistant", t, 1, True) for i, t in enumerate(["ask " + "x" * 100, "  \nfirst note\nmore\n\nother", "b", "y" * 300, "c", " "])]
    f = [(1, "r", "all", None, 0, 6, 0), (1, "k1", "turn", "r", 0, 2, 0), (1, "k2", "turn", "r", 2, 4, 0), (1, "k3", "turn", "r", 4, 6, 0)]
    args = spark.createDataFrame(m, ROWS), spark.createDataFrame(f, FOLDS)
    whole = cuts.consolidation_brief(*args, 2000).first().brief
    lead = "Grouped completed context covering 3 folds and 2 agent notes: "
    told = ["User: ask " + "x" * 73 + "... · Assistant: 1 of 2 rows", "User: b · Assistant: 1 of 2 rows", "User: c · Assistant: 1 of 2 rows", "first note more", "y" * 157 + "..."]
    assert whole == lead + " | ".join(told) + "."
    for cap in (100, 150, 220, 300, 400):
        room = cap - len(lead) - 1
        named = max(1, min(5, (room + 3) // 27))
        tail = f" | {5 - named} more in this group" if named < 5 else ""
        left, kept = room - len(tail) - 3 * (named - 1), {}
        order = sorted(range(named), key=lambda i: (len(told[i]), i))
        for n, i in enumerate(order):
            owed = max(1, left // (named - n))
            kept[i] = told[i] if len(told[i]) <= owed else told[i][: max(0, owed - 3)].rstrip() + "..."
            left -= len(kept[i])
        assert cuts.consolidation_brief(*args, cap).first().brief == lead + " | ".join(kept[i] for i in range(named)) + tail + "."


def test_source_collapses_the_largest_first(spark):
    m = [(1, i, "user", t, 1, True) for i, t in enumerate(['"q"\n\\ é', "y" * 500, "z" * 50])]
    f = [(1, "r", "all", None, 0, 3, 0), *((1, f"k{i}", "turn", "r", i, i + 1, 0) for i in range(3))]
    args = spark.createDataFrame(m, ROWS), spark.createDataFrame(f, FOLDS)
    full = cuts.consolidation_source(*args).first()
    parsed = json.loads(full.text)
    assert full.collapsed == 0 and full.bytes == len(full.text.encode()) and [c["contents"][0]["text"] for c in parsed] == [x[3] for x in m]
    for most, gone in ((full.bytes, []), (full.bytes - 1, [1]), (10, [0, 1, 2])):
        r = cuts.consolidation_source(*args, most).first()
        assert [i for i, c in enumerate(json.loads(r.text)) if "collapsed" in c] == gone and r.collapsed == len(gone) and r.bytes == len(r.text.encode())


def test_orientation_ends_with_what_does_not_fit(spark):
    m = [(1, i, "user", "t" * n, 1, True) for i, n in enumerate([5, 300, 5, 5, 5, 300])]
    f = spark.createDataFrame([(1, "a", "turn", None, 2, 3, 0), (1, "b", "turn", None, 0, 2, 0), (1, "c", "turn", None, 3, 5, 0)], FOLDS)
    got = {(r.fold, r.side): r.rows for r in cuts.orientation(spark.createDataFrame(m, ROWS), f, chars=100).collect()}
    assert got == {("a", "before"): "", ("a", "after"): "3,4", ("b", "before"): "", ("b", "after"): "2,3", ("c", "before"): "2", ("c", "after"): ""}
