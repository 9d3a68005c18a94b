"""Verbs, epochs and streams: properties that must hold for any session."""

import random

import pytest

from loglathe.engine import Engine, Refused
from loglathe.operators import ledgers, scoring, texts, transcript
from loglathe.plans.epoch import STUB, Session, epochs
from loglathe.policy import Policy, serving_budget
from loglathe.streaming import epochs as streams

MESSAGES = "session long, idx long, role string, text string, nbytes long, terminal boolean"
POLICY = Policy.resolve(budget_tokens=1000, consolidate_after=2, fresh_tail=0.1)


def session(seed: int, n: int = 40, sid: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows, role = [], "user"
    for i in range(n):
        text = "".join(rng.choice("abcdefg hij\né") for _ in range(rng.randint(5, 600)))
        rows.append((sid, i, role, text, len(text.encode()), role == "assistant"))
        role = {"user": "assistant", "assistant": rng.choice(["user", "user", "custom"]), "custom": "user"}[role]
    return rows


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(session(1, 12, 1) + session(2, 8, 2), MESSAGES)


@pytest.fixture(scope="module")
def engine(spark, messages):
    turns = transcript.complete_turns(messages).where("session = 1").orderBy("turn").collect()
    spans = spark.createDataFrame([(1, turns[0]["start"], turns[0]["end"]), (1, turns[1]["start"], turns[1]["end"])], "session long, start long, end long")
    return Engine.over(messages, POLICY).fold(spans)


def test_marks_wait_and_commit(engine):
    assert engine.shown().count() == 0 and engine.marks.count() == 2
    assert engine.commit().shown().count() == 2 and engine.commit().marks.count() == 0
    with pytest.raises(Refused):
        engine.unmark("fold_none")


def test_equal_decisions_have_equal_names(engine):
    spans = engine.marks.select("session", "start", "end")
    assert engine.fold(spans).marks.count() == 2


def test_recovery_is_lossless(engine, messages):
    e = engine.commit()
    fold = e.folds.orderBy("start").first()
    got = [(r["idx"], r["text"]) for r in e.recover(fold["fold"]).collect()]
    want = [(r["idx"], r["text"]) for r in messages.where(f"session = 1 and idx >= {fold['start']} and idx < {fold['end']}").orderBy("idx").collect()]
    assert got == want


def test_peeks_give_the_whole_source(engine):
    e = engine.commit()
    fold = e.folds.orderBy("start").first()["fold"]
    source = "\n".join(r["text"] for r in e.recover(fold).collect())
    got, at = "", 0
    while at is not None:
        r = e.peek(fold, at, 1024).first()
        got, at = got + r["text"], r["next"]
    assert got == source
    with pytest.raises(Refused):
        e.peek(fold, 0, 10)


def test_expand_refold_lease(engine):
    e = engine.commit()
    fold = e.folds.orderBy("start").first()["fold"]
    opened = e.expand(fold)
    assert opened.shown().count() == 1 and opened.refold(fold).shown().count() == 2
    for _ in range(8):
        opened = opened.generation()
    assert opened.shown().count() == 2


def test_projection_keeps_what_is_not_folded(engine, messages):
    p = engine.commit().projection()
    folded = engine._source(engine.marks.select("session", "start", "end")).count()
    assert p.where("kind = 'row'").count() == messages.count() - folded and p.where("kind = 'fold'").count() == 2


def test_protection(spark, engine):
    first = spark.createDataFrame([(1, 0)], "session long, idx long")
    pinned = engine.commit().protect(first)
    assert pinned.shown().count() == 1 and pinned.unprotect(first).shown().count() == 2
    with pytest.raises(Refused):
        engine.protect(engine.messages.select("session", "idx"))
    with pytest.raises(Refused):
        Engine.over(engine.messages, POLICY).protect(first).fold(engine.marks.select("session", "start", "end"))


def test_briefs_and_boundaries(spark, engine):
    e = engine.commit()
    fold = e.folds.orderBy("start").first()["fold"]
    assert e.rebrief(fold, "abc").folds.where("brief = 'abc'").count() == 1
    with pytest.raises(Refused):
        e.rebrief(fold, "--")
    assert e.reboundary(fold).shown().count() == 1
    with pytest.raises(Refused):
        e.fold(spark.createDataFrame([(1, 1, 2)], "session long, start long, end long"))
    assert e.status(limit=1).count() == 1 and e.receipts().count() == 2 and e.tree().where("parent is not null").count() == 0


# ------------------------------------------------------------------- epochs
@pytest.mark.parametrize("seed", range(12))
def test_epochs_keep_all_rows(seed):
    s = Session(POLICY)
    total = 0
    for _, idx, role, _, nbytes, terminal in session(seed, 120):
        total += nbytes
        s.step(idx, role, nbytes, terminal)
        assert [x.start for x in s.spans[1:]] == [x.end for x in s.spans[:-1]] and s.spans[0].start == 0 and s.spans[-1].end == idx + 1
        assert sum(x.source for x in s.spans) == total
        assert all(x.nbytes == (STUB if x.role == "fold" else x.source) for x in s.spans)
    assert s.commits and all(c["after"] <= c["before"] for c in s.commits)
    assert any(c["applied"] for c in s.commits)


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for i in range(5) for r in session(i, 60, i)]
    df = spark.createDataFrame(rows, MESSAGES)
    batch = sorted(map(tuple, epochs(df, POLICY).collect()), key=str)
    inbox = str(tmp_path / "in")
    for low in (0, 20, 40):  # three arrivals, the middle one twice
        df.where(f"idx >= {low} and idx < {low + 20}").coalesce(1).write.mode("append").parquet(inbox)
    df.where("idx >= 20 and idx < 40").coalesce(1).write.mode("append").parquet(inbox)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    q = streams.epoch_stream(source, POLICY).writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("commits").collect()), key=str) == batch and batch


def test_usage_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    q = streams.usage_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("usage").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").agg({"calls": "sum"}).first()[0] > 0


def test_quarantine(spark):
    good, bad = streams.quarantine(spark.createDataFrame([(1, 0), (2, 1), (4, 2)], "revision long, base long"))
    assert good.count() == 2 and bad.first()["revision"] == 4


# ------------------------------------------------------------------- vectors
def test_policy_is_validated_as_a_whole():
    assert serving_budget(272_000) == 272_000 - 16_384 and serving_budget(1000) == 900
    for bad in ({"max_target": 1.2}, {"min_target": 0.9}, {"fresh_tail": 0.5}, {"consolidate_after": 1}, {"unknown": 1}, {"refold_ratio": 0.95}):
        with pytest.raises(ValueError):
            Policy.resolve(**bad)
    with pytest.raises(ValueError):
        Policy.resolve(budget_tokens=5000).servable()
    assert Policy().servable() == Policy()


def test_threshold_of_the_self_test(spark):
    rows = [(i, c, ok, True, 0) for i, (c, ok) in enumerate([(0.9, True), (0.8, True), (0.7, True), (0.6, True), (0.5, False)])]
    d = spark.createDataFrame(rows, "doc_id long, confidence double, correct boolean, opportunity boolean, class int")
    assert tuple(scoring.calibrate(d).first()) == (0.6, 4)
    assert scoring.calibrate(d.where("confidence < 0.9")).first()[0] is None


def test_seeded_order():
    assert texts.seeded_shuffle(list(range(50)), "a") == texts.seeded_shuffle(list(range(50)), "a") != texts.seeded_shuffle(list(range(50)), "b")
    assert sorted(texts.seeded_shuffle(list(range(50)), "a")) == list(range(50)) and texts.seeded_shuffle([], "a") == []
    assert all(0 <= x < 1 << 32 for x in texts.seeded_sequence("s", 20)) and len(texts.seeded_sequence("s", 20)) == 20


def test_as_of_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "session int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c")], "session int, t int, v string")
    got = lambda **k: {(r["session"], r["t"]): r["found"] for r in ledgers.as_of(left, right, "t", "v", **k).collect()}
    assert got() == {(1, 5): "a", (1, 1): None, (2, 3): None}
    assert got(strict=False) == {(1, 5): "b", (1, 1): None, (2, 3): None}
    assert got(forward=True) == {(1, 5): "c", (1, 1): "a", (2, 3): None}
    assert got(forward=True, strict=False) == {(1, 5): "b", (1, 1): "a", (2, 3): None}


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame([r for i in range(4) for r in session(i, 30, i)], MESSAGES)
    run = lambda d: sorted(map(tuple, transcript.fresh_tail(d, POLICY).collect()))
    assert run(df) == run(df.repartition(7).orderBy("text"))
