"""Exact top-k and hard negatives against brute force, and the oracles in SQL."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from loglathe.llm import grid, maxscore, negatives
from loglathe.llm.queries import ORACLE_SQL, QUERIES

from .. import oracle

SCHEMA = "vec_id long, embedding array<double>, label int, score int, row string, rank int"


def scaled(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def brute_top(rows, k, scale, every):
    held = [(i, r[0], scaled(r[1], scale)) for i, r in enumerate(rows)]
    held = [h for h in held if h[2] is not None and sum(x * x for x in h[2]) < 1 << 61]
    out = []
    for i, q, a in held:
        if q is not None and q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), math.inf if v is None else v) for j, v, b in held if j != i and len(a) == len(b))[:k]
            out += [(q, rank, None if v == math.inf else v, -s) for rank, (s, v) in enumerate(found, 1)]
    return sorted(out, key=repr)


def brute_negatives(rows, scale, every, positives, most):
    held = [(i, r[0], scaled(r[1], scale), r[2]) for i, r in enumerate(rows) if r[2] is not None]
    held = [h for h in held if h[2] is not None and sum(x * x for x in h[2]) < 1 << 61]
    out = []
    for i, q, a, label in held:
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), math.inf if v is None else v, own == label) for j, v, b, own in held if j != i and len(a) == len(b))
        for p, v, _ in [s for s in scored if s[2]][:positives]:
            some = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:most]
            out += [(q, v, rank, None if w == math.inf else w, -p, -s) for rank, (s, w, _) in enumerate(some, 1)]
    return sorted(out, key=repr)


def vectors(seed: int, n: int, dim: int = 12) -> list[tuple]:
    rng = np.random.RandomState(seed)
    centre = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centre[rng.randint(6)] * rng.choice([0.2, 1.0]) + rng.standard_normal(dim) * 0.3
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.randint(4)), 1, "x", 2))
    return rows


def odd(rows: list[tuple]) -> list[tuple]:
    """Copies, ties, nulls, zeros, other lengths, extreme components, and repeated or missing identifiers."""
    n, first = len(rows), rows[0]
    values = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [1e300] * 12, [1e8] * 12, [1.0] * 3, [-1.0] * 3, [2.0] * 3]
    more = [(n + i, v, 1, 1, "x", 2) for i, v in enumerate(values)]
    more += [(100 * (n + i), v, None if i % 2 else 2, 1, "x", 2) for i, v in enumerate(values)]
    more += [rows[0], (None, *first[1:]), (None, *rows[3][1:]), (None, first[1], None, 1, "x", 2), (-300, *rows[5][1:]), ((1 << 63) - 1, *rows[6][1:])]
    return rows + more + [(10_000 + i, *rows[7][1:]) for i in range(30)]


@pytest.mark.parametrize("shard", [2048, 16])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "FIRST", shard // 2)
    monkeypatch.setattr(grid, "FEWEST", 64)
    rows = odd(vectors(1, 220))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in maxscore.top(df).collect()), key=repr)
    assert got == brute_top(rows, 20, 64, 20)
    assert maxscore.top(df.limit(0)).count() == 0
    assert maxscore.top(df.where("vec_id = 1")).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 22])
def test_shard_leaves_out_only_what_cannot_compete(scale):
    rng = np.random.RandomState(2)
    x = rng.randint(-30, 30, (500, 10)) * (rng.random((500, 10)) < 0.4) * scale
    shard = maxscore.Shard(x, np.arange(500), np.arange(500))
    queries = rng.randint(-30, 30, (40, 10)) * scale
    plain = queries @ x.T
    for which in ("all", 0, 1, "twentieth", "best", "none"):
        least = {"all": np.full(40, np.nan), "twentieth": np.sort(plain, 1)[:, -20], "best": plain.max(1), "none": plain.max(1) + 1}.get(which, np.full(40, which))
        query, place, score = shard.competitive(queries, np.asarray(least, np.float64))
        assert len(query) < 500 or which in ("all", 0, 1, "twentieth")
        got = sorted((q, p) for q, p, s in zip(query.tolist(), place.tolist(), score.tolist()) if which == "all" or s >= least[q])
        if which == "none" and scale > 1:
            continue
        assert got == [(q, p) for q in range(40) for p in range(500) if which == "all" or plain[q, p] >= least[q]]
        assert score.tolist() == plain[query, place].tolist()


@pytest.mark.parametrize(("block", "sample"), [(512, 20_000), (8, 50)])
def test_negatives(spark, monkeypatch, block, sample):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PIECE", 4 * block)
    monkeypatch.setattr(negatives.centroids, "__defaults__", (sample, 256))
    monkeypatch.setattr(grid, "FEWEST", 64)
    rows = odd(vectors(4, 260))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in negatives.mine(df, every=10).collect()), key=repr)
    expected = [tuple(None if x == math.inf else x for x in r) for r in brute_negatives(rows, 256, 10, 5, 10)]
    assert got == sorted(expected, key=repr)
    assert len(got) > 500
    assert negatives.mine(df.limit(0)).count() == 0


def test_bounds_hold_and_stop_only_below():
    rng = np.random.RandomState(5)
    x = rng.randint(-200, 200, (600, 16))
    table = pa.table({"vec_id": np.arange(600), "row": np.arange(600), "label": np.arange(600) % 3, "cluster": negatives.nearest(x.astype(float), x[:12].astype(float)), "vector": pa.array(x.tolist(), pa.list_(pa.int32()))})
    lists = negatives.Lists(table, 16, x[:12].astype(float))
    for query in rng.randint(-200, 200, (20, 16)):
        low, high = lists.bounds(query)
        for b, (vectors_of, *_) in enumerate(lists.blocks):
            plain = vectors_of @ query
            assert low[b] <= plain.min() and plain.max() <= high[b]
    assert negatives.window(7) == (3, 6) and negatives.window(0) == (0, 0)
    least, most = negatives.window(-10)
    assert least > most


@pytest.mark.parametrize("name", ["op12_exact_topk", "op13_hard_negatives"])
def test_query_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(spark, oracle.database(sf), QUERIES[name], ORACLE_SQL[name], sf) == ""


def test_labels_move(spark):
    """Where 7 divides vec_id the label is the next one, from 9 to 0."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf).collect()), key=repr)
    assert got == brute_negatives(rows, 256, 100, 5, 10)
