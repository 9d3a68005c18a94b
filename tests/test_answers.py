"""Answers within windows against a plain scan."""

from __future__ import annotations

import random
import re

from loglathe.operators import answers

ROWS = "session int, idx int, role string, text string"
QUESTIONS = "session int, chain int, wave int, at int, ids array<string>"


def test_windows_against_plain_scans(spark):
    draw = random.Random(12)
    rows = [(s, i, draw.choice(["assistant", "assistant", "user"]), draw.choice(["", " ", "a.b: one ", "xa.b: no", "axb: no\n c-1 : two\nrest", "words", "## c-1 title", None])) for s in range(5) for i in range(40)]
    asked = []
    for s in range(6):
        for chain in (0, 1):
            at = sorted(draw.sample(range(40), 5))
            asked += [(s, chain, w, None if draw.random() < 0.3 else a, draw.choice([["a.b"], ["c-1"], ["a.b", "c-1"]])) for w, a in enumerate(at)]
    q, r = spark.createDataFrame(asked, QUESTIONS), spark.createDataFrame(rows, ROWS)
    for around, fallback in ((answers.ANSWER, False), (answers.HEADING, True)):
        found = answers.first_answers(r, q, around, fallback)
        got = {(x.session, x.chain, x.wave): (x.delivered, x.matched, x.at, x.skipped, x.text) for x in found.collect()}
        assert len(got) == len(asked)
        for s, chain, wave, at, ids in asked:
            if at is None:
                assert got[s, chain, wave] == (False, False, None, None, "")
                continue
            later = [a for t, c, w, a, _ in asked if (t, c, w) == (s, chain, wave + 1)]
            end = later[0] if later and later[0] is not None else 10**9
            texts = [(i, x) for t, i, role, x in rows if t == s and at < i < end and role == "assistant" and x and x.strip(" ")]
            one = around[0] + "|".join(map(re.escape, ids)) + around[1]
            hits = [n for n, (_, x) in enumerate(texts) if re.search(one, x)]
            n = hits[0] if hits else 0 if fallback and texts else None
            assert got[s, chain, wave] == ((True, bool(hits), texts[n][0], n, texts[n][1]) if n is not None else (True, False, None, None, ""))
    read = {(x.session, x.chain, x.wave, x.id): x.answer for x in answers.parsed(answers.first_answers(r, q), q).collect()}
    assert {v for v in read.values()} <= {None, "one", "two"} and len({v for v in read.values()}) == 3
