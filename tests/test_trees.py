"""Intervals of session trees against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loglathe.operators import forest, rollback, trees

SCHEMA = "session long, entry long, parent long, idx int, role string, kind string, error boolean, call boolean, result boolean, nbytes long"


def tree(session: int, parents: list, marked=()) -> list[tuple]:
    return [(session, 1000 * session + i, None if p is None else 1000 * session + p, i, "assistant" if i in marked else "user", "message", False, False, False, 4) for i, p in enumerate(parents)]


def random_tree(draw: random.Random, n: int, fork: float) -> list:
    return [None if i == 0 or draw.random() < 0.03 else draw.randrange(i) if draw.random() < fork else i - 1 for i in range(n)]


@pytest.fixture(scope="module")
def forests(spark):
    draw = random.Random(4)
    rows = tree(1, [None]) + tree(2, [None, 0, 1, 2, 3, 4, 5, 6]) + tree(3, [None, 0, 0, 0, 1, 1, 4]) + tree(4, [None, None, 1, 0])
    for s, (n, fork) in enumerate([(40, 0.1), (60, 0.5), (50, 1.0), (120, 0.02)], 5):
        rows += tree(s, random_tree(draw, n, fork), {i for i in range(n) if draw.random() < 0.2})
    rows += [(9, 9001, 9999, 0, "user", "message", False, False, False, 4), (9, 9002, 9003, 1, "user", "message", False, False, False, 4), (9, 9003, 9002, 2, "assistant", "message", False, False, False, 4)]
    return rows


def walks(rows: list[tuple]) -> tuple[dict, dict]:
    """Parents that count, and each entry's ancestors from itself on."""
    idx = {r[1]: r[3] for r in rows}
    session = {r[1]: r[0] for r in rows}
    link = {r[1]: r[2] if r[2] in idx and session[r[2]] == r[0] and idx[r[2]] < r[3] else None for r in rows}
    above = {}
    for e in idx:
        above[e] = [e]
        while link[above[e][-1]] is not None:
            above[e].append(link[above[e][-1]])
    return link, above


def test_intervals_hold_exactly_what_descends(spark, forests):
    e = spark.createDataFrame(forests, SCHEMA)
    _, above = walks(forests)
    got = {r.entry: r for r in trees.intervals(e).collect()}
    assert len(got) == len(forests)
    for x, r in got.items():
        assert r.depth == len(above[x]) - 1
        inside = {y for y, q in got.items() if q.session == r.session and r.pre <= q.pre < r.pre + r.size}
        assert inside == {y for y in got if x in above[y]}
    for s in {r.session for r in got.values()}:
        pre = sorted(r.pre for r in got.values() if r.session == s)
        assert pre == list(range(len(pre)))


def test_descendants_and_heights(spark, forests):
    _, above = walks(forests)
    got = {r.entry: (r.descendants, r.height) for r in forest.descends(spark.createDataFrame(forests, SCHEMA)).collect()}
    expected = {x: (sum(x in a for a in above.values()) - 1, max(a.index(x) for a in above.values() if x in a)) for x in above}
    assert got == expected


def test_branches(spark, forests):
    e = spark.createDataFrame(forests, SCHEMA)
    _, above = walks(forests)
    leaf = {r[0]: r[1] for r in sorted(forests, key=lambda r: r[3])}
    got = {(r.session, r.leaf, r.entry, r.distance) for r in forest.branch(e).collect()}
    assert got == {(s, x, y, i) for s, x in leaf.items() for i, y in enumerate(above[x])}
    dead = {r.entry for r in forest.dead_entries(e).collect()}
    assert dead == set(above) - {y for x in leaf.values() for y in above[x]}


def test_nearest_marked_ancestor(spark, forests):
    e = spark.createDataFrame(forests, SCHEMA)
    role = {r[1]: r[4] for r in forests}
    _, above = walks(forests)
    got = {r.entry: r.found for r in trees.nearest_above(e, F.col("role") == "assistant").collect()}
    assert got == {x: next((y for y in a[1:] if role[y] == "assistant"), None) for x, a in above.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trees.intervals(none).count() == forest.descends(none).count() == forest.branch(none).count() == trees.nearest_above(none, F.col("role") == "user").count() == 0


def test_long_session_takes_linear_rows(spark):
    """100,000 entries with a fork in every thousand: the walk has two elements a segment, and no closure is made."""
    n = 100_000
    e = spark.range(n).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("entry"), F.when(F.col("id") > 0, F.when(F.col("id") % 1000 == 0, F.col("id") - 500).otherwise(F.col("id") - 1)).alias("parent"), F.col("id").cast("int").alias("idx"))
    s = trees.segments(e)
    assert trees.skeleton(s).count() == 1 + 2 * 99
    i = trees.intervals(e)
    assert i.count() == n
    assert i.agg(F.max("depth"), F.max("size")).first() == (n - 1 - 99 * 499, n)
    assert forest.descends(e).where("descendants = 99999 and entry = 0").count() == 1


def test_recovery(spark):
    def row(i, parent, role, kind="message", error=False, call=False, result=False, nbytes=10, session=1):
        return (session, 100 * session + i, None if parent is None else 100 * session + parent, i, role, kind, error, call, result, nbytes)

    rows = [
        row(0, None, "user"), row(1, 0, "assistant", call=True), row(2, 1, "user", result=True), row(3, 2, "assistant", error=True), row(4, 3, "system", "custom"),
        *(row(*x, session=2) for x in [(0, None, "user"), (1, 0, "assistant"), (2, 1, "user")]),
        row(0, None, "user", session=3), row(1, 0, "assistant", call=True, session=3), row(2, 1, "user", session=3), row(3, 2, "assistant", error=True, nbytes=11, session=3),
        row(0, None, "assistant", error=True, session=4),
        # the answer on another branch does not count
        row(0, None, "user", session=5), row(1, 0, "assistant", call=True, session=5), row(2, 1, "user", result=True, session=5), row(3, 1, "user", session=5), row(4, 3, "assistant", error=True, session=5),
    ]
    e = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in rollback.recover(e, rollback.branch_rows(e)).collect())
    assert got == [
        (1, 103, 104, 102, 2, 3, 4, 3, True, True, None),
        (3, 303, 303, 302, 1, 3, 4, 3, True, False, "unanswered"),
        (4, 400, 400, None, 1, 3, 1, 0, True, True, None),
        (5, 504, 504, 503, 1, 3, 4, 3, True, False, "unanswered"),
    ]
