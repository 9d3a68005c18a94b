"""Scalar functions, JSON lines, digests and artifacts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions import scalars as X
from loglathe.sources import files as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


TEXT = "añ日👍z"


@pytest.mark.parametrize("n", range(12))
def test_bytes_are_cut_between_characters(spark, n):
    raw = TEXT.encode()
    head = raw[:n].decode("utf-8", "ignore")
    tail = raw[max(0, len(raw) - n):].decode("utf-8", "ignore") if n else ""
    assert one(spark, X.utf8_head(F.col("t"), n), t=TEXT) == head
    assert one(spark, X.utf8_tail(F.col("t"), n), t=TEXT) == tail
    assert one(spark, X.utf8_slice(F.col("t"), n), t=TEXT) == raw[n:].decode("utf-8", "ignore")


def test_scalars(spark):
    assert one(spark, X.utf16_length(F.col("t")), t=TEXT) == 6
    assert one(spark, X.bounded_subject(F.col("t"), 8), t="abcd  efghij") == "abcd..."
    assert one(spark, X.one_line(F.col("t")), t="  a \n\t b ") == "a b"
    assert one(spark, X.retrieval_tokens(F.col("t")), t="The __Window_ window, which 1234 ab Über") == ["window", "window", "1234"]
    assert one(spark, X.normalized_answer(F.col("t")), t='"`./src/a.c:12`".') == "src/a.c"
    assert one(spark, X.overflowed(F.col("t")), t="Prompt is too long") is True
    assert one(spark, X.mcp_server(F.col("t"), "x"), t="mcp__git__log") == "git" and one(spark, X.mcp_server(F.col("t"), "x"), t="read") == "x"
    assert one(spark, X.safe_segment(F.col("t")), t="a b/ç") == "a_b__"
    assert 0.88 < one(spark, X.sigmoid(F.col("t")), t=2.0) < 0.89
    assert one(spark, X.wilson_lower(F.col("s"), F.col("n")), s=0, n=0) == 0.0
    assert one(spark, X.prefix_length(F.col("a"), F.col("b")), a=[1, 2, 3], b=[1, 2]) == 2 and one(spark, X.prefix_length(F.col("a"), F.col("b")), a=[1, 2], b=[1, 3]) == 1
    assert one(spark, X.structurally_valid_brief(F.col("t"), 5), t="a-b-c") is True


ENTRIES = [
    {"id": "1", "parentId": None, "type": "message", "message": {"role": "user", "content": "hi"}},
    {"id": "2", "parentId": "1", "type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "toolCall", "id": "c", "name": "read", "arguments": {"p": 1}}, {"type": "text", "text": "b"}], "usage": {"input": 3, "output": 4}}},
    {"id": "3", "parentId": "2", "type": "compaction", "summary": "s"},
    {"id": "4", "parentId": "3", "type": "branch_summary", "summary": ""},
    {"id": "5", "parentId": "3", "type": "custom"},
]


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, ENTRIES)) + "\n")
    e = S.read_lines(spark, str(path), S.ENTRY)
    m = {r["entry"]: r for r in S.entry_messages(e).withColumn("text", S.content_text(F.col("content"))).collect()}
    assert {k: r["role"] for k, r in m.items()} == {"1": "user", "2": "assistant", "3": "compactionSummary"}
    assert m["1"]["text"] == "hi" and m["2"]["text"] == "a\nb" and m["3"]["text"] == "s"
    calls = S.tool_calls(e).collect()
    assert [(c["entry"], c["call_id"], c["name"], json.loads(c["arguments"])) for c in calls] == [("2", "c", "read", {"p": 1})]
    assert e.where("id = '2'").select(S.provider_tokens(F.col("message.usage")).alias("n")).first()["n"] == 7
    path.write_text(path.read_text() + "{broken\n")
    with pytest.raises(Exception):
        S.read_lines(spark, str(path), S.ENTRY).collect()
    assert S.read_lines(spark, str(path), S.ENTRY, strict=False).count() == 5
    assert [r["line"] for r in S.bad_lines(spark, str(path)).collect()] == [6]


def test_records(spark):
    assert one(spark, S.exact_record(F.col("t"), ["b", "a"]), t='{"a":1,"b":2}') and not one(spark, S.exact_record(F.col("t"), ["a"]), t='{"a":1,"b":2}')
    assert one(spark, S.keys_within(F.col("t"), ["a"], ["b"]), t='{"a":1,"b":2}') and not one(spark, S.keys_within(F.col("t"), ["c"], ["a", "b"]), t='{"a":1}')


def test_sinks(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "out")
    S.write_exclusive(df, path)
    with pytest.raises(Exception):
        S.write_exclusive(df, path)
    S.append_lines(df, path)
    assert spark.read.json(path).count() == 6
    S.write_atomic(df, path)
    assert spark.read.json(path).count() == 3


def test_trees_and_artifacts(spark, tmp_path):
    (tmp_path / "t/b").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("x")
    (tmp_path / "t/b/c.txt").write_text("y")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    r = S.tree_digest(spark, str(tmp_path / "t")).first()
    assert r["files"] == 2 and r["sha"] == sha(f"a.txt {sha('x')}\nb/c.txt {sha('y')}")
    expected = spark.createDataFrame([("a.txt", sha("x")), ("b/c.txt", "z"), ("d", "q")], "path string, sha string")
    assert {x["path"]: x["what"] for x in S.expected_files(S.files(spark, str(tmp_path / "t")), expected).collect()} == {"b/c.txt": "changed", "d": "missing"}
    df = spark.createDataFrame([("o1", b"abc"), ("o2", b"abc"), ("o3", b"d")], "owner string, content binary")
    descriptors = S.store_artifacts(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2 and S.verify_artifacts(spark, descriptors, str(tmp_path / "store")).count() == 0
    wrong = descriptors.withColumn("bytes", F.col("bytes") + 1)
    assert S.verify_artifacts(spark, wrong, str(tmp_path / "store")).count() == 3


def test_results_are_projected(spark):
    rows = [("bash", "é" * 20_000 + "end"), ("read", "start" + "x" * 20_000), ("read", "short"), ("mcp__git__log", "y" * 20_000), ("other", "z" * 90_000)]
    got = S.project_results(spark.createDataFrame(rows, "tool string, text string")).collect()
    assert got[0]["projected"].endswith("end") and got[1]["projected"].startswith("start") and got[2]["projected"] == "short" and not got[4]["cut"]
    assert all(len(r["projected"].encode()) <= 16_384 for r in got[:4]) and got[3]["server"] == "git"


def test_evidence_of_runs(spark):
    f = spark.createDataFrame([("r", "evidence.json"), ("r", "evidence.1.json"), ("r", "evidence.2.json"), ("s", "evidence.json"), ("s", "log.jsonl")], "run string, name string")
    assert {r["run"]: r["name"] for r in S.newest_evidence(f).collect()} == {"r": "evidence.2.json", "s": "evidence.json"}
