"""Rows that lack an identifier, or hold extreme ones."""

from __future__ import annotations

import json
import random

import numpy as np

from loglathe.llm import chat, classifier

from .conftest import prose

CHATS = "conv_id long, turn long, role string, text string"


def calls(*items) -> str:
    return json.dumps({"tool_calls": list(items)})


def test_calls_without_identifier_have_lines(spark):
    good = {"id": "a", "name": "reply", "arguments": {"text": "x"}}
    rows = [
        (1, 0, "assistant", calls({"id": None, "name": "reply", "arguments": {"text": "n"}}, good, {"name": "reply", "arguments": {"text": "m"}})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "done"})),
        (1, 2, "assistant", calls("no object", 7)),
        (1, 3, "assistant", " \n" + calls({"id": "b", "name": "reply", "arguments": {"text": "x"}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "b", "content": "late"}).replace("tool_call_id", "tool_call\\u005fid")),
        (1, 5, "tool", json.dumps({"tool_call_id": None, "content": "lost"})),
    ]
    got = {(r.turn, r.part): (r.status, r.call_id, r.valid, r.depth) for r in chat.format_chats(spark.createDataFrame(rows, CHATS)).collect()}
    assert got == {
        (0, 0): ("unanswered", None, True, None), (0, 1): ("linked", "a", True, 0), (0, 2): ("unanswered", None, True, None),
        (2, 0): ("unanswered", None, False, None), (2, 1): ("unanswered", None, False, None), (3, 0): ("linked", "b", True, 0), (5, 0): ("orphan", None, None, None),
    }


def test_extreme_turns(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(None, t, r, "text") for t in (low, low + 1, high, None) for r in ("user", "assistant")]
    assert chat.format_chats(spark.createDataFrame(rows, CHATS)).count() > 0


def test_every_distinct_call_has_a_line(spark):
    draw = random.Random(9)
    odd = [None, "a", "b", "", 1, 1.5, True, [], {}, "é"]
    rows = []
    for i in range(1500):
        made = [{k: draw.choice(odd) for k in ("id", "name", "arguments", "after") if draw.random() < 0.8} if draw.random() < 0.9 else draw.choice(odd) for _ in range(draw.randint(1, 4))]
        rows.append((draw.choice([None, 1, 2, 3]), draw.choice([None, i, 7]), draw.choice(["assistant", None]), calls(*made)))
    expected = sum(len(json.loads(t)["tool_calls"]) for *_, t in set(rows))
    got = chat.format_chats(spark.createDataFrame(rows, CHATS))
    assert got.count() == expected
    assert got.where("line is null").count() == 0


def test_sample_without_identifiers(spark, monkeypatch):
    monkeypatch.setattr(classifier, "SAMPLE", 200)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(400)] + [" ".join("#$%" + str(i) for i in range(80))] * 200
    for ids in ([None] * len(texts), [5] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        got = classifier.classify(df, through=("doc_id", "text")).collect()
        good = [r.kept for r in got if not r.text.startswith("#")]
        bad = [r.kept for r in got if r.text.startswith("#")]
        assert np.mean(good) > 0.9 and not any(bad)


def test_nothing_in_the_sample(spark, monkeypatch):
    """Copies of one text that all stay outside: their posterior is the score, not one half."""
    monkeypatch.setattr(classifier, "SAMPLE", 1)
    df = spark.createDataFrame([(None, " ".join("#$%" + str(i) for i in range(80)))] * 3000, "doc_id long, text string")
    got = classifier.classify(df).collect()
    assert len(got) == 3000 and len({(r.score, r.kept) for r in got}) == 1
    assert abs(got[0].score - got[0].label) < 0.5
