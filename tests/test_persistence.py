"""States kept as tables: killed between any two sinks, the same tables come out."""

from __future__ import annotations

import random

import pytest

from loglathe.streaming import persistence

OPS = "session long, revision long, op string, id long"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Six files of operations, in order."""
    draw, at, rows = random.Random(3), {s: 0 for s in range(4)}, []
    folder = tmp_path_factory.mktemp("operations")
    for i in range(6):
        part = []
        for _ in range(30):
            s = draw.randrange(4)
            at[s] += 1
            part.append((s, at[s], draw.choice(["add", "add", "remove"]), draw.randrange(8)))
        rows += part
        spark.createDataFrame(part, OPS).coalesce(1).write.parquet(f"{folder}/p/{i}")
    return f"{folder}/p", rows


def run(spark, source, root, kill=None):
    """The stream over the files; killed once after a step of a batch, and started again."""
    state = {"left": kill}

    def between(step):
        if state["left"] and state["left"][1] == step and len(persistence.batches(spark, root, "records")) == state["left"][0] + 1:
            state["left"] = None
            raise RuntimeError("killed")

    for _ in range(2):
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*").writeStream.foreachBatch(persistence.sink(root, 2, between)).option("checkpointLocation", f"{root}-offsets").trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
            break
        except Exception as e:
            assert "killed" in str(e)
    assert state["left"] is None


def tables(spark, root):
    names = {"records": persistence.RECORDS, "deltas": persistence.DELTAS, "heads": persistence.HEADS, "checkpoints": persistence.CHECKPOINTS}
    return {n: sorted(map(tuple, persistence.table(spark, root, n, s, persistence.batches(spark, root, n)).collect())) for n, s in names.items()}


def expected(rows):
    last = {}
    for s, r, op, i in sorted(rows):
        last[s, i] = (op, r)
    return sorted((s, i, r) for (s, i), (op, r) in last.items() if op == "add")


def test_killed_batches_run_again(spark, source, tmp_path):
    path, rows = source
    plain = f"{tmp_path}/plain"
    run(spark, path, plain)
    assert sorted(map(tuple, persistence.load(spark, plain).collect())) == expected(rows)
    assert persistence.audit(spark, plain).count() == 0
    whole = tables(spark, plain)
    assert persistence.batches(spark, plain, "checkpoints") == [1, 3, 5]
    for kill in [(1, "records"), (2, "heads"), (3, "deltas"), (3, "checkpoints")]:
        root = f"{tmp_path}/{kill[0]}-{kill[1]}"
        run(spark, path, root, kill)
        assert tables(spark, root) == whole


def test_states_of_the_past_and_faults(spark, source, tmp_path):
    _, rows = source
    root = f"{tmp_path}/past"
    for b in range(3):
        persistence.persist(spark.createDataFrame(rows[b * 60 : (b + 1) * 60], OPS), b, root, 2)
    assert persistence.load(spark, root, 0).count() == 0
    for b in (1, 2, 3):
        assert sorted(map(tuple, persistence.load(spark, root, b).collect())) == expected(rows[: b * 60])
    spark.createDataFrame([(0, 99, 5)], "session long, base long, revision long").write.parquet(f"{root}/heads/batch=7")
    spark.createDataFrame([(1, 5, 900, "add")], "session long, id long, revision long, change string").write.parquet(f"{root}/deltas/batch=7")
    assert {tuple(r) for r in persistence.audit(spark, root).collect()} == {(0, 7, "chain"), (1, 7, "record")}
