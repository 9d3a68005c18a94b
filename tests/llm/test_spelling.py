"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loglathe.llm import spelling


def near(a: str | bytes, b: str | bytes) -> bool:
    """Exactly one letter put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows: list[tuple], one_in: int | None) -> set[tuple]:
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = Counter({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    found, form = {}, {}
    for w, n in counts.items():
        all_near = [x for x in counts if near(w, x)]
        best = min(all_near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        found[w] = len(all_near)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, found[w], counts[form[w]] if form[w] else None))
    return out


def check(spark, rows: list[tuple], one_in: int | None = 97) -> set[tuple]:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling.grouped(docs, one_in).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(rows, one_in)
    return set(got)


def test_texts_of_variants(spark):
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefé") for _ in range(draw.randint(5, 9))) for _ in range(40)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(120):
            w = draw.choice(base[: draw.randint(1, len(base))])
            at, c = draw.randrange(len(w)), draw.choice("abcé")
            words.append(draw.choice([w] * 5 + [w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w.upper()]))
        rows.append((d, " ".join(words)))
    got = check(spark, rows)
    assert sum(r[1] is not None for r in got) > 50
    check(spark, rows, None)


def test_odd_texts(spark):
    rows = [
        (None, "Wordy wordy WORDY word"),
        (1, None),
        (2, ""),
        (3, "×÷×÷× ×÷×÷× ×÷×÷×÷ ×÷×÷× ×÷×÷×÷ ×÷×÷×÷ İstanbul İstanbul İstanbul ΑΒΓΔΕ"),
        (3, "aaaaa aaaaaa aaaaaaa aaaaaaaa " * 5 + "aaaaaa " * 40),
        (4, " ".join(["x" * n for n in range(5, 400, 3)] + ["x" * n for n in (299, 300, 301)]) + " "),
        (4, " ".join(["x" * n for n in range(5, 400, 3)] * 2 + ["x" * n for n in (299, 300, 301)] * 3)),
        (5, "yz" * 3000 + " " + "yz" * 3000 + "y " + "yz" * 3000 + " "),
        (6, ("yz" * 3000 + " ") * 8 + ("yz" * 3000 + "y ") * 3 + ("q" + "yz" * 3000 + " ") * 3),
        (7, "naïve naïve naïve naive naive naive naive naive naivé naïves"),
        (7, "naïve naïve naïve naive naive naive naive naive naivé naïves"),
        (9, "no words here: 12 34 _ab_"),
    ]
    rows.append((8, "stone " * 26 + "stonex " * 13 + "stonexy " * 6 + "stonexyz " * 3))
    check(spark, rows)
    chain = {r[0]: r[1:3] for r in check(spark, rows, None)}
    assert chain["stonexyz"] == ("stonexy", "stone")
    check(spark, rows, 1)


def test_empty_and_clashing(spark):
    check(spark, [])
    check(spark, [(1, None), (None, None)])
    docs = spark.createDataFrame([(1, "thing thing thing", "a", 1, 2)], "doc_id long, text string, word string, n int, form int")
    assert [tuple(r) for r in spelling.grouped(docs).collect()] == [("thing", None, "thing", 3, 0, None)]


def test_large_texts_in_pieces(spark, monkeypatch):
    rows = [(1, "Thing thing thinge thinge thinge " * 3)]
    monkeypatch.setattr(spelling, "AT_ONCE", 10)
    assert list(spelling.runs("Äb cD")) == ["Äb", "cd"]
    assert list(spelling.runs("Äb cD eFghij kLm")) == ["Äb", "cd", "efghij", "klm"]
    check(spark, rows)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 5)
    draw = random.Random(5)
    words = ["prefix" + "".join(draw.choice("abc") for _ in range(4)) for _ in range(60)]
    rows = [(i, " ".join(words * draw.randint(1, 3))) for i in range(4)]
    check(spark, rows, None)


@pytest.mark.parametrize("letters", ["ab", "abéÿz"])
def test_automaton_is_minimal_and_numbers_words(letters):
    draw = random.Random(7)
    for size in (1, 2, 60, 400):
        words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, 8))).encode("latin-1") for _ in range(size)})
        lengths = np.array([len(w) for w in words])
        wide = int(lengths.max()) + 1
        auto = spelling.Automaton(spelling._codes(words, wide), lengths)
        rest = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
        assert auto.states == len(rest)
        for m in set(lengths.tolist()):
            own = [w for w in words if len(w) == m]
            codes = spelling._codes(own, wide)
            assert [words[i] for i in auto.number(codes, m)] == own
            query, number = auto.near(codes, m, m // 2)
            got = {(own[q], words[x]) for q, x in zip(query.tolist(), number.tolist())}
            assert got == {(a, b) for a in own for b in words if near(a, b) and a[: m // 2] == b[: m // 2]}
