"""Common prefixes by halving against plain comparison."""

from __future__ import annotations

import random

from loglathe.operators import prefixes

ITEMS = "session int, list string, pos long, item string"


def test_common_prefixes(spark):
    draw = random.Random(8)
    lists = {}
    for s in range(6):
        base = [draw.choice(["a", "b", "", None]) for _ in range(draw.randint(0, 40))]
        lists[s, "x"] = base
        at = draw.randint(0, len(base))
        lists[s, "y"] = draw.choice([base, base[:at], [*base[:at], "other", *base[at + 1 :]], [*base, "more"], []])
        lists[s, "z"] = [*base[:at], "other"]
    rows = [(s, name, i, v) for (s, name), x in lists.items() for i, v in enumerate(x)]
    pairs = [(s, a, b) for s in range(7) for a, b in (("x", "y"), ("y", "z"), ("x", "gone"))]
    got = {(r.session, r.left, r.right): (r.left_items, r.right_items, r.common) for r in prefixes.common(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(pairs, "session int, left string, right string")).collect()}
    for s, a, b in pairs:
        x, y = lists.get((s, a), []), lists.get((s, b), [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert got[s, a, b] == (len(x), len(y), n)


def test_topology(spark):
    good = {"raw": "ab", "expanded": "abc", "folded": "f", "refolded": "fg", "warm": "fw", "carrier": "fwc", "withdrawn": "fwd"}
    cases = [good, good | {"expanded": "acb"}, good | {"withdrawn": "fd"}, {k: v for k, v in good.items() if k != "carrier"}]
    rows = [(s, k, i, c) for s, case in enumerate(cases) for k, v in case.items() for i, c in enumerate(v)]
    got = {r.session: r for r in prefixes.topology(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got[0].confirmed and got[0].carrier_withdrawn_common == 2 and got[0].raw_items == 2
    assert not got[1].confirmed and not got[1].raw_prefix_of_expanded and got[1].fork_after_warm
    assert not got[2].confirmed and not got[2].warm_prefix_of_withdrawn and not got[2].fork_after_warm
    assert not got[3].complete and not got[3].confirmed and got[3].raw_items is None
