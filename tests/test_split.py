"""Pieces of a session by size against a plain loop."""

from __future__ import annotations

import random

from loglathe.operators import selection


def test_split_by_size(spark):
    draw = random.Random(1)
    sizes = {s: [draw.choice([0, 0, 1, 5, 9, 10, 11, 25]) for _ in range(draw.randint(1, 60))] for s in range(12)} | {90: [0, 0, 50, 1], 91: [50, 0, 0, 3], 92: [0]}
    rows = [(s, 2 * i, n) for s, own in sizes.items() for i, n in enumerate(own)]
    got = sorted(tuple(r) for r in selection.split_by_size(spark.createDataFrame(rows, "session int, idx int, nbytes long"), 10).collect())
    expected = []
    for s, own in sizes.items():
        pieces, used = [[]], 0
        for i, n in enumerate(own):
            if used > 0 and used + n > 10:
                pieces.append([])
                used = 0
            pieces[-1].append(i)
            used += n
        expected += [(s, p, 2 * x[0], 2 * x[-1] + 1, sum(own[i] for i in x)) for p, x in enumerate(pieces)]
    assert got == sorted(expected)
