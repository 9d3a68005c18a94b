"""Groups and projections beyond the sizes of the provided tables, against exact figures."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loglathe import catalogue
from loglathe.operators import scoring, states

from . import oracle


@pytest.mark.parametrize("p", [0.5, 0.2])
def test_binomial_tail_of_groups_of_any_size(spark, p):
    sizes = [(7, 6), (60, 31), (61, 0), (61, 61), (100, 55), (100, 3), (1000, 520), (5000, 2600), (5000, 990), (5000, 5000)]
    groups = [(n, s, int(i)) for i, (n, s) in enumerate(sizes)]
    d = spark.createDataFrame(groups, "n long, s long, class int").select("class", F.lit(0.5).alias("confidence"), "s", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).withColumn("correct", F.col("i") <= F.col("s"))
    got = {r["class"]: (r["n"], r["s"], r["tail"]) for r in scoring.binomial_tail(d, p).collect()}
    assert len(got) == len(groups)
    for n, s, i in groups:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(s, n + 1))
        assert got[i][:2] == (n, s) and abs(got[i][2] - exact) < 1.1e-6


def test_projections_longer_than_32_events(spark):
    kinds = ["view"] * 50 + ["purchase"] + ["view"] * 40 + ["purchase", "purchase", "purchase"]
    ks = list(range(50)) + [0] + list(range(40)) + [7, 7, 8]
    e = spark.createDataFrame([(1, i + 1, kind, k) for i, (kind, k) in enumerate(zip(kinds, ks))], "session long, ordinal long, kind string, k long")
    shown, want = [], {}
    for i, (kind, k) in enumerate(zip(kinds, ks)):
        before, shown = shown, ([k] if kind == "purchase" else shown + [k])
        if i:
            common = next((j for j, (a, b) in enumerate(zip(before, shown)) if a != b), min(len(before), len(shown)))
            change = "rewrite" if common < len(before) else "append" if common < len(shown) else "identical"
            want[i + 1] = (change, common, len(before), len(shown))
    got = {r["ordinal"]: (r["change"], r["common"], r["before"], r["after"]) for r in states.changes(states.successive(e)).collect()}
    assert got == want
    n = {r["change"]: (r["n"], r["common"]) for r in states.change_rollup(states.successive(e)).collect()}
    assert n == {c: (sum(x[0] == c for x in want.values()), sum(x[1] for x in want.values() if x[0] == c)) for c in ("append", "rewrite", "identical")}


def test_binomial_tails_of_larger_tables_equal_their_oracles_and_are_whole(spark, tmp_path):
    for name, rest in (("documents", "n_chars"), ("labels", "quality, toxic")):
        duckdb.sql(f"COPY (SELECT doc_id + k * 10000000 AS doc_id, {rest} FROM '/root/testdata/sf0.01/{name}.parquet', range(40) r(k)) TO '{tmp_path}/{name}.parquet'")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    groups = []
    for name in ("binomial_tail", "binomial_tail_large"):
        assert oracle.difference(spark, db, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) == ""
        groups += [r["n"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    labels, documents = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("labels", "documents"))
    assert min(groups) <= 60 < max(groups) and sum(groups) == labels.join(documents, "doc_id").count()


def test_binomial_tail_alone_gives_groups_of_every_size(spark, tmp_path):
    sizes = {0: (3, 2), 10: (60, 31), 20: (61, 30), 30: (500, 260), 40: (500, 0), 50: (4000, 1990)}  # by hundredths of confidence: cases, correct ones
    cases = [(1 + i + 10_000 * c, c, int(i < s)) for c, (n, s) in sizes.items() for i in range(n)]
    db = duckdb.connect()
    for name, rows, columns in (("documents", [(i, c) for i, c, _ in cases], "doc_id long, n_chars long"), ("labels", [(i, ok, 0) for i, _, ok in cases], "doc_id long, quality long, toxic long")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    run, sql = catalogue.QUERIES["binomial_tail"], catalogue.ORACLE_SQL["binomial_tail"]
    assert oracle.difference(spark, db, run, sql, str(tmp_path)) == ""
    got = {round(100 * r["confidence"]): (r["n"], r["s"], r["tail"]) for r in run(spark, str(tmp_path)).collect()}
    assert {c: x[:2] for c, x in got.items()} == sizes
    for c, (n, s) in sizes.items():
        assert abs(got[c][2] - sum(math.comb(n, k) for k in range(s, n + 1)) / 2**n) < 1e-6


def test_salience_tokenises_texts_once(spark):
    """What is left to run reads stored tokens; a rare and a frequent term count alike."""
    from loglathe.operators import retrieval as R

    docs = spark.createDataFrame([(1, "alpha beta. gamma alpha"), (2, "alpha. beta! delta"), (2, "delta"), (3, None), (4, "")], "doc long, text string")
    got = []
    for R.FREQUENT in (1, 100_000):  # all terms by the shuffle, all by the broadcast
        r = R.salience(docs)
        assert "regexp_extract_all" not in r._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted(map(tuple, r.collect())))
    assert got[0] == got[1] and [x[0] for x in got[0]] == [1, 2]


def test_index_of_positions_has_no_frame_to_the_end(spark):
    """Such frames are read again for each row of a session."""
    from loglathe.operators import snapping as S

    rows = spark.createDataFrame([(1, p) for p in range(1, 9)], "session long, pos long")
    roots = spark.createDataFrame([], "session long, fold string, start long, end long, tool boolean")
    units = spark.createDataFrame([(1, 2, 4, 1), (1, 6, 8, 2)], "session long, start long, end long, turn long")
    r = S.index(rows, roots, units, 2)
    assert "unboundedfollowing" not in r._jdf.queryExecution().analyzed().toString().lower()
    assert {x["pos"]: (x["f"], x["cap"], x["done"]) for x in r.collect()} == {1: (4, 8, None), 2: (4, 8, None), 3: (4, 8, 4), 4: (8, None, 4), 5: (8, None, 4), 6: (8, None, 4), 7: (8, None, 8), 8: (None, None, 8)}


def test_carriage_reads_stored_texts(spark):
    """What is left to run after ``contained`` is put together reads its two tables as stored."""
    from loglathe.operators import containment

    texts = spark.createDataFrame([(1, 7, "one two")], "session long, item long, text string").withColumn("text", F.upper("text"))
    facts = spark.createDataFrame([(1, 3, "TWO")], "session long, fact long, value string")
    r = containment.contained(texts, facts)
    assert "upper(" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(x) for x in r.collect()] == [(1, "3", "7")]


def test_visible_folds_come_from_one_pass_without_joins(spark):
    """A join on the parent sends all roots, which have none, to one task; a branch for each level holds memory for each."""
    from loglathe.operators import forest as R

    sizes = {1: [10, 20, 30], 2: [4000], 3: [900, 900, None, 100, 5000], 4: [None]}
    rows = [(s, 2 * i + k, role, n, k == 1) for s, turns in sizes.items() for i, size in enumerate(turns) for k, (role, n) in enumerate((("user", 0 if size is not None else None), ("assistant", size)))]
    m = spark.createDataFrame(rows, "session long, idx int, role string, nbytes long, terminal boolean")
    f = R.folds(m)
    plan = R.visible(f, 3000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    got = {r["fold"]: tuple(r)[2:] for r in f.collect()}
    assert len(got) == 5 + 2 + 8 + 2 == f.count()
    assert got["chapter-3-0"] == ("chapter", "all-3", 0, 4, 1800) and got["chapter-3-1"] == ("chapter", "all-3", 4, 8, 100)
    assert got["turn-1-3"] == ("turn", "all-1", 4, 6, 30) and got["turn-3-5"] == ("turn", "all-3", 8, 10, 5000)
    assert got["all-3"] == ("all", None, 0, 10, 6900) and got["all-4"] == ("all", None, 0, 2, None)
    assert sorted(r["fold"] for r in R.visible(f, 3000).collect()) == ["all-1", "chapter-3-1", "turn-2-1", "turn-3-1", "turn-3-2", "turn-3-5"]
