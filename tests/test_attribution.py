"""Containment against substring tests, spans, and the carriage of facts."""

from __future__ import annotations

import random

import pytest

from loglathe.operators import attribution, containment, retrieval, spans


@pytest.mark.parametrize(("piece", "shard"), [(16 << 20, 20_000), (60, 3)])
def test_contained_equals_substring_tests(spark, monkeypatch, piece, shard):
    monkeypatch.setattr(containment, "PIECE", piece)
    monkeypatch.setattr(containment, "SHARD", shard)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abé ") for _ in range(draw.randint(1, 5)))
    texts = [(draw.choice([1, 2, 3]), i, "".join(word() for _ in range(draw.randint(0, 12)))) for i in range(80)] + [(1, 900, None), (2, 901, ""), (4, 902, "abab"), (None, 903, "abc"), (1, 904, "ab" * 500)]
    facts = [(draw.choice([1, 2, 3]), i, word()) for i in range(40)] + [(1, 800, ""), (2, 801, None), (5, 802, "ab"), (1, 803, "ab"), (1, 804, "ab")]
    got = [tuple(r) for r in containment.contained(spark.createDataFrame(texts, "session int, item int, text string"), spark.createDataFrame(facts, "session int, fact int, value string")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(s, str(f), str(i)) for s, f, v in facts if v for t, i, x in texts if t == s and x and v in x}


def test_contained_has_no_pairs_in_its_plan(spark):
    texts, facts = spark.createDataFrame([(1, 1, "a b")], "session int, item int, text string"), spark.createDataFrame([(1, 1, "a")], "session int, fact int, value string")
    plan = containment.contained(texts, facts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_covering_spans(spark):
    rows = spark.createDataFrame([(s, i, f"t{i}") for s in (1, 2, 3) for i in range(8)], "session int, idx int, text string")
    s = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 3, 4), (1, "c", 6, 8), (2, "d", 0, 8)], "session int, fold string, start int, end int")
    got = {(r.session, r.idx): r.fold for r in spans.covering(rows, s, "fold").collect()}
    assert got == {(x, i): next((f for y, f, a, b in [(1, "a", 1, 3), (1, "b", 3, 4), (1, "c", 6, 8), (2, "d", 0, 8)] if y == x and a <= i < b), None) for x in (1, 2, 3) for i in range(8)}
    assert spans.held(rows, s, "fold").count() == sum(f is not None for f in got.values())


def test_classes(spark):
    branch = spark.createDataFrame([(1, 10, 0, "alpha one"), (1, 11, 1, "beta two"), (1, 12, 2, "gamma three")], "session int, entry int, idx int, text string")
    every = branch.union(spark.createDataFrame([(1, 13, 3, "delta four, alpha")], branch.schema))
    folds = spark.createDataFrame([(1, "f", 1, 2), (1, "g", 2, 3)], "session int, fold string, start int, end int")
    briefs = spark.createDataFrame([(1, "f", "told: epsilon"), (1, "g", "told: zeta")], "session int, fold string, brief string")
    v = attribution.view(branch, every, folds, folds.where("fold = 'f'"), briefs)
    facts = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "beta"), (1, 3, "gamma"), (1, 4, "delta"), (1, 5, "epsilon"), (1, 6, "zeta"), (1, 7, "eta x"), (2, 8, "alpha")], "session int, fact int, value string")
    got = {r.fact: (r["class"], r.visible_raw, r.visible_brief, r.recoverable_source, r.recoverable_brief, r.off_branch) for r in attribution.attributed(v, facts).collect()}
    assert got == {
        "1": ("visible-raw", "10", "", "", "", ""),
        "2": ("recoverable", "", "", "11", "", ""),
        "3": ("visible-raw", "12", "", "", "", ""),
        "4": ("absent-off-branch", "", "", "", "", "13"),
        "5": ("visible-brief", "", "f", "", "", ""),
        "6": ("recoverable", "", "", "", "g", ""),
        "7": ("absent", "", "", "", "", ""),
        "8": ("absent", "", "", "", "", ""),
    }


def test_variants_and_best(spark):
    probes = spark.createDataFrame([(1, 1, "7", "trace-a-01"), (1, 2, "12", None), (1, 3, "word", None), (1, 4, "word", "trace-b-02"), (1, 5, "123", None)], "session int, probe int, value string, trace string")
    got = sorted((r.probe, r.kind, r.value) for r in attribution.variants(probes).collect())
    assert got == [(1, "binding", "trace-a-01: 07"), (1, "binding", "trace-a-01: 7"), (3, "value", "word"), (4, "binding", "trace-b-02: word"), (4, "value", "word"), (5, "value", "123")]
    branch = spark.createDataFrame([(1, 10, 0, "trace-a-01: 07 and 123")], "session int, entry int, idx int, text string")
    none = spark.createDataFrame([], "session int, fold string, start int, end int, brief string")
    v = attribution.view(branch, branch, none, none, none)
    best = {r.probe: (r.value_class, r.binding_class) for r in attribution.best_carriage(v, probes).collect()}
    assert best == {1: (None, "visible-raw"), 2: (None, None), 3: ("absent", None), 4: ("absent", "absent"), 5: ("visible-raw", None)}


def test_relevant_documents(spark):
    docs = spark.createDataFrame([(1, "some passage here"), (2, None), (3, "passage")], "doc long, text string")
    queries = spark.createDataFrame([("q1", "passage"), ("q2", "absent"), ("q3", None)], "query string, text string")
    assert sorted(tuple(r) for r in retrieval.relevant(docs, queries).collect()) == [("q1", 1), ("q1", 3)]
