"""Spans moved to boundaries: hand-made sessions, and random ones against a plain loop."""

from __future__ import annotations

import random

from loglathe.operators import snapping

SPANS = "session int, span long, start long, end long"


def tables(spark, n, roots, units, boundary, spans):
    rows = spark.createDataFrame([(1, i, f"row-{i}") for i in range(n)], "session int, pos long, id string")
    r = spark.createDataFrame([(1, f, a, b, t) for f, a, b, t in roots], "session int, fold string, start long, end long, tool boolean")
    u = spark.createDataFrame([(1, a, b, t) for a, b, t in units], "session int, start long, end long, turn long")
    b = spark.createDataFrame([(1, boundary)] if boundary is not None else [], "session int, boundary long")
    return rows, r, u, b, spark.createDataFrame([(1, i, a, e) for i, (a, e) in enumerate(spans)], SPANS)


def plain(roots, units, boundary, span, mode, max_turns):
    """Passes over the definition until nothing moves: the span, and whether anything was corrected."""
    s, e = span
    trail, n = [span], 0
    while True:
        before = (s, e)
        for _, a, b, _ in sorted(roots, key=lambda r: r[1]):
            near_s, near_e = s - a <= b + 1 - s, b - e <= e - (a - 1)
            keep = lambda near: n > 0 or mode == "absorb" or mode == "nearest" and near
            if a < s <= b:
                s = a if keep(near_s) else b + 1
            if a <= e < b:
                e = b if keep(near_e) else a - 1
            trail.append((s, e))
        if boundary is not None:
            e = min(e, boundary)
        trail.append((s, e))
        s = next((a for a, b, _ in units if a <= s < b), s)
        e = next((b - 1 for a, b, _ in units if a <= e < b), e)
        trail.append((s, e))
        inside = [u for u in units if u[0] >= s and u[1] <= e + 1]
        turns = sorted({t for _, _, t in inside})[:max_turns]
        if inside:
            e = min(e, max(b for _, b, t in inside if t in turns) - 1)
        n += 1
        if (s, e) == before:
            return (s, e) if len(set(trail)) > 1 and e >= s else None


def test_random_sessions(spark):
    draw = random.Random(11)
    for _ in range(4):
        n = 60
        cuts = sorted(draw.sample(range(n), 16))
        roots = [(f"f{a}", a, b - 1, draw.random() < 0.2) for a, b in zip(cuts[::2], cuts[1::2])]
        starts = sorted(draw.sample(range(n - 8), 18))
        turn, units = 0, []
        for a, b in zip(starts, starts[1:]):
            turn += not units or draw.random() < 0.5
            units.append((a, b if draw.random() < 0.8 else a + 1, turn))
        spans = [tuple(sorted((draw.randrange(n), draw.randrange(n)))) for _ in range(60)]
        boundary = draw.choice([None, n - 6])
        rows, r, u, b, sp = tables(spark, n, roots, units, boundary, spans)
        places = snapping.index(rows.select("session", "pos"), r, u, 2).persist()
        got = {(x.span, x.mode): (x.start, x.end) for x in snapping.snapped(sp, places, b).collect()}
        expected = {(i, m): x for i, span in enumerate(spans) for m in snapping.MODES if (x := plain(roots, units, boundary, span, m, 2))}
        assert got == expected
        fine = {x.span: x.aligned for x in snapping.aligned(sp, places, u, 2).collect()}
        for i, (a, e) in enumerate(spans):
            over = [x for x in units if x[1] > a and x[0] <= e]
            assert fine[i] == bool(over and over[0][0] == a and over[-1][1] == e + 1 and len({t for *_, t in over}) <= 2 and all(x[1] == y[0] for x, y in zip(over, over[1:])))


def test_whole_folds_and_choice(spark):
    roots = [("a", 0, 3, False), ("b", 4, 6, False), ("c", 8, 9, False), ("d", 10, 12, True)]
    units = [(i, i + 1, i // 2 + 1) for i in range(14)]
    spans = [(1, 5), (0, 6), (5, 9), (8, 11), (4, 5), (0, 3)]
    rows, r, u, b, sp = tables(spark, 14, roots, units, None, spans)
    places = snapping.index(rows.select("session", "pos"), r, u, 4)
    got = {x.span: (x.start, x.end, x.folds) for x in snapping.whole_folds(sp, places, r).collect()}
    assert got == {0: (0, 6, 2)}  # already whole; a gap; a tool's; one fold only
    best = {x.span: (x.reading, x.start, x.end) for x in snapping.chosen(sp, places, b, r, u, 4).collect()}
    assert best[0][0] == "direct" and best[5] == ("direct", 0, 3)


def test_requests(spark):
    rows, r, u, b, _ = tables(spark, 6, [("a", 1, 3, False)], [], None, [])
    nested = spark.createDataFrame([(1, "n")], "session int, fold string")
    asked = [(1, 0, ["row-0", "row-2"]), (1, 1, ["a"]), (1, 2, ["row-5", "a"]), (1, 3, ["n", "row-0"]), (1, 4, ["gone"]), (1, 5, []), (1, 6, ["row-0", ""]), (1, 7, None), (1, 8, ["row-0"] * 65), (2, 9, ["row-0"])]
    got = {x.span: (x.start, x.end, x.refused) for x in snapping.resolved(spark.createDataFrame(asked, "session int, span int, ids array<string>"), rows, r, nested).collect()}
    none = lambda why: (None, None, why)
    assert got == {0: (0, 2, None), 1: (1, 3, None), 2: (1, 5, None), 3: none("nested"), 4: none("unknown"), 5: none("shape"), 6: none("shape"), 7: none("shape"), 8: none("shape"), 9: none("unknown")}


def test_no_rows(spark):
    rows, r, u, b, sp = tables(spark, 0, [], [], None, [])
    places = snapping.index(rows.select("session", "pos"), r, u, 4)
    assert snapping.snapped(sp, places, b).count() == snapping.whole_folds(sp, places, r).count() == 0
