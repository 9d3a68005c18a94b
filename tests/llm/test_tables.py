"""Vectors, archives and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from loglathe.llm import common as C
from loglathe.llm import graph, minhash, packing, quality, secrets, vectors, warc

from .conftest import SF, prose


# ------------------------------------------------------------------------ 3
def brute_vectors(rows, least=0.98):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float64) / np.abs(rows[i][1]).max() for i in (a, b))
                links[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= least
    component = list(range(n))
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(links[todo.pop()]):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        component[a] = min(rows[i][0] for i in seen)
    return {rows[i][0]: (int(links[i].sum()), component[i]) for i in range(n)}


def test_near_vectors(spark, monkeypatch):
    rng = np.random.RandomState(2)
    rows = []
    for k in range(30):
        centre = rng.standard_normal(64)
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.2, 0.3])], k % 3))
    rows += [(len(rows) + i, v, 0) for i, v in enumerate([None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 64, [1.0] * 64, [2.0] * 64, [1.0] * 8, [1e300] * 64])]
    rows += [(len(rows), [1.0] * 64, None)]
    expected = brute_vectors(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, digest string, id int")
    for small, cut in ((24, 2048), (2, 4)):
        monkeypatch.setattr(vectors, "SMALL", small)
        monkeypatch.setattr(vectors.graph.cut, "__defaults__", (cut, 2_000_000))
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.neighbours(df).collect()}
        assert got == expected
    assert vectors.neighbours(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.RandomState(0)
    o, q = rng.standard_normal((2, 64))
    o, q = o / np.linalg.norm(o), (q + 2 * o) / np.linalg.norm(q + 2 * o)
    found, within = [], []
    for r in range(400):
        turn = vectors.rotation(64, r)
        s = np.where(turn @ o >= 0, 1.0, -1.0)[None]
        est, bound = vectors.estimate(s, np.abs(turn @ o).sum(keepdims=True) / 8, (turn @ q)[None])
        found.append(est[0, 0])
        within.append(abs(est[0, 0] - o @ q) <= bound[0])
    assert abs(np.mean(found) - o @ q) < 0.02 and np.mean(within) > 0.99


def test_small_table_of_vectors(spark):
    e = C.table(spark, SF, "embeddings").toPandas()
    rows = list(zip(e.vec_id.tolist(), [list(map(float, v)) for v in e.embedding], e.label.tolist()))[:300]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.neighbours(df).collect()} == brute_vectors(rows)


# ------------------------------------------------------------------------ 9
def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "GAP", 10)
    rows = [(i, f"http://WWW.h{i % 5}.example.org:80/p{i}?q=a b#f", f"<html>{i % 11}" + "é" * (60 if i % 2 else 3)) for i in range(60)]
    rows += [(100, None, None), (101, "https://h0.example.org", ""), (102, "odd\r\nurl", "z" * 500_000), (103, "http://x/", "z" * 500_000), (None, "http://x/", "z" * 500_000), (103, "http://x/", "z" * 500_000)]
    rows += [(104, "http://ta\tb\nhost.org/a\tb", "t" * 200), (105, "//h\r\nb/", "t" * 200), (106, "\t\n", "u")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = C.new_path(spark, "archives")
    directory = warc.write_index(warc.write_archives(df, folder), folder)
    captures = warc.read_index(directory, folder, warc.keys_of(df))
    got = warc.read_records(captures, folder, payloads=True).collect()
    assert len(got) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= warc.LEAST:
            first[html] = min(i, first.get(html, i))
    for r in got:
        p = payload[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), hashlib.sha256(p).hexdigest())
        lead = first.get(p.decode(), r["page_id"]) if r["page_id"] is not None else None
        assert r["record_type"] == ("response" if lead == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if lead == r["page_id"] else lead)
        assert r["payload"] == (p if r["record_type"] == "response" else None)
    few = spark.createDataFrame([(rows[3][1],), ("https://h0.example.org/",), ("http://nowhere/",), ("http://ta\tb\nhost.org/a\tb",)], "url string")
    found = warc.read_index(directory, folder, warc.keys_of(few)).collect()
    assert {r["page_id"] for r in found} == {3, 101, 104}
    assert warc.url_key("http://a.B.org:8080/x?y#z") == "org,b,a:8080)/x?y" and warc.url_key(None) == ")/"
    empty = warc.write_archives(df.limit(0), C.new_path(spark, "archives"))
    none = warc.write_index(empty, folder)
    assert none.count() == 0 and warc.read_index(none, folder, warc.keys_of(few)).count() == 0


def test_directory_is_searched_by_halving():
    class Counted(str):
        n = 0

        def __lt__(self, other):
            Counted.n += 1
            return str.__lt__(self, other)

    rng = random.Random(4)
    keys = sorted(f"k{rng.randint(0, 3000):05}" for _ in range(8000))
    blocks = [keys[i : i + 2] for i in range(0, len(keys), 2)]
    firsts, lasts = [Counted(b[0]) for b in blocks], [Counted(b[-1]) for b in blocks]
    for key in (keys[0], keys[-1], keys[4001], "a", "z", "k00000x"):
        Counted.n = 0
        assert list(warc.blocks_of(firsts, lasts, [Counted(key)])) == [i for i, b in enumerate(blocks) if str(b[0]) <= key <= str(b[-1])]
        assert Counted.n < 40


# ----------------------------------------------------------------- pipeline
def test_pipeline(spark, odd, none):
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = C.stored(out, "test")
        kept[name] = docs
    rules = {r["doc_id"] for r in quality.rules(odd).where("kept").collect()}
    assert {r["doc_id"] for r in kept["quality rules"].collect()} == rules
    once = kept["n-gram Jaccard join"]
    ids = [r["doc_id"] for r in once.collect()]
    assert len(ids) == len(set(ids)) and 7 not in ids and 8 not in ids and 6 in ids
    assert all(set(kept[n].columns) == set(corpus_pipeline.DOCUMENTS) for n, _ in corpus_pipeline.STAGES[:-1])
    assert {r["doc_id"] for r in kept["best-fit packing"].collect()} == set(ids)
    assert [f(spark, none, SF).count() for _, f in corpus_pipeline.STAGES] == [0] * 5


def test_pipeline_redacts(spark):
    from .conftest import prose
    import random

    rng = random.Random(9)
    rows = [(i, prose(rng, 60) + f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + prose(rng, 60), "en", "s", 1) for i in range(5)] + [(9, None, None, None, None)]
    out = {r["doc_id"]: r for r in corpus_pipeline.without_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert all("[SECRET]" in out[i]["text"] and hashlib.sha1(str(i).encode()).hexdigest() not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"]) for i in range(5))
    assert out[9]["text"] is None


def test_redaction_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "token = abcdef0123456789", 0)], "doc_id long, text string, n_chars long")
    plan = secrets.redacted(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


# ------------------------------------------------------- identifiers, hot keys
def test_repeated_and_null_identifiers_keep_their_own_links(spark):
    near = lambda x: [1.0, x, 0.0, 0.0]
    rows = [(5, near(0.0), 1), (5, [0.0, 0.0, 1.0, 0.0], 1), (6, near(0.01), 1), (7, [0.0, 0.0, 1.0, 0.01], 1), (None, near(0.02), 1), (None, [0.0, 0.0, 0.0, 1.0], 1), (8, near(0.0), 2)]
    got = [tuple(r) for r in vectors.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == [(5, 1, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 1, 5, False), (8, 0, 8, True), (None, 0, None, True), (None, 2, 5, False)]
    rng = random.Random(8)
    one, two = prose(rng, 100), prose(rng, 100)
    docs = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail"), (None, one), (None, None), (None, None), (1, one)]
    out = minhash.neighbours(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in out if r["doc_id"] == 2) == [(3, 1)]
    assert sorted((r["n_links"], r["component_id"]) for r in out if r["doc_id"] == 3) == [(1, 1)]
    assert sum(r["kept"] for r in out) == 4  # one of each group, and the two without words


def test_hot_joins_equal_plain_ones(spark):
    left = spark.range(3000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).union(spark.range(2000).select(F.lit(99).cast("long").alias("a"), "id"))
    right = left.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    plain = sorted(left.join(right.drop("c"), "a").collect())
    assert all(sorted(C.hot_join(left, right, ["a"], size).collect()) == plain for size in (5000, 10**6, 10**9))


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 if i < 1000 else 1000 for i in [*range(400), *range(1000, 1041)]}
