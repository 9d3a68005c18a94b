"""States and fold records: what single values break, beyond the registered cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loglathe.functions import shapes
from loglathe.operators import records

SHA = "a" * 64
REF = {"sessionId": "s", "entryId": "e", "role": "user", "sha256": SHA}
STATE = {"version": 2, "kind": "checkpoint", "sessionId": "1", "revision": 3, "expanded": [], "protected": [REF], "prepared": None, "stateSha256": SHA, "foldRefs": []}


def refused(spark, *values) -> list:
    rows = [(1, i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    got = {r.i: r.refused for r in records.states(spark.createDataFrame(rows, "session long, i int, json string")).collect()}
    return [got[i] for i in range(len(values))]


def test_states_one_by_one(spark):
    delta = {k: v for k, v in STATE.items() if k != "foldRefs"} | {"kind": "delta", "baseRevision": 2, "baseStateSha256": SHA, "addFoldRefs": [{"id": "f", "sha256": SHA}], "removeFoldIds": []}
    cases = [
        (None, "json"), ("", "json"), ("{", "json"), ("[]", "keys"), ("3", "keys"), ("null", "keys"), ({}, "keys"), (STATE, None), (delta, None),
        (STATE | {"version": 2.0}, None), (STATE | {"version": "2"}, "version"), (STATE | {"kind": "other"}, "kind"), (STATE | {"sessionId": "2"}, "sessionId"), (STATE | {"sessionId": 1}, "sessionId"),
        (STATE | {"revision": 1 << 53}, "revision"), (STATE | {"revision": True}, "revision"), (STATE | {"revision": None}, "revision"), (STATE | {"expanded": {}}, "expanded"), (STATE | {"expanded": [""]}, "expanded"),
        (STATE | {"expanded": [str(i) for i in range(1024)]}, None), (STATE | {"expanded": [str(i) for i in range(1025)]}, "expanded"), (STATE | {"protected": [REF, REF]}, "protected"),
        (STATE | {"prepared": {"any": 1}}, None), (STATE | {"leases": {"": 1}}, "leases"), (STATE | {"leases": []}, "leases"), (STATE | {"briefs": {"f": "x" * 2001}}, "briefs"),
        (STATE | {"foldRefs": [{"id": "f", "sha256": SHA}] * 2}, "foldRefs"), (STATE | {"surfacing": 1}, "retired"), (delta | {"foldRefs": []}, "keys"),
        (STATE | {"briefs": {f"f{i}": "é" * 2000 for i in range(400)}}, "bytes"),
    ]
    assert refused(spark, *(c[0] for c in cases)) == [c[1] for c in cases]


def test_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], "session long, json string, kind string, fold int")
    assert records.states(none).count() == records.fold_records(none).count() == 0


def test_marks(spark):
    fold = {"mark": "fold", "id": "x", "kind": "chapter", "parts": [{"kind": "raw", "ref": REF}], "brief": "abc", "briefProvenance": {"kind": "model", "provider": "p", "model": "m", "effort": "e"}, "origin": "ladder", "ordinal": 0}
    cases = [
        (STATE | {"pendingMarks": [fold]}, None), (STATE | {"pendingMarks": [fold | {"parts": []}]}, "pendingMarks"), (STATE | {"pendingMarks": [fold | {"origin": "user"}]}, "pendingMarks"),
        (STATE | {"pendingMarks": [fold | {"briefProvenance": {"kind": "model"}}]}, "pendingMarks"), (STATE | {"pendingMarks": [fold, {"mark": "refold", "id": "x", "origin": "agent", "ordinal": 1}]}, None),
    ]
    assert refused(spark, *(c[0] for c in cases)) == [c[1] for c in cases]


def test_shapes_name_the_first_breach(spark):
    shape = shapes.record({"a": shapes.whole(1, 5), "b": shapes.items(shapes.text("^x"), 2)}, {"c": shapes.either(shapes.nothing, shapes.one_of("y"))})
    rows = ['{"a":1,"b":[]}', '{"a":0,"b":[]}', '{"a":1,"b":["x","q"]}', '{"a":1,"b":["x","x","x"]}', '{"a":1,"b":[],"c":null}', '{"a":1,"b":[],"c":"z"}', '{"a":1}', '{"a":9,"b":7}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, json string").select("i", shape(F.try_parse_json("json"), "keys").alias("why"))
    assert [r.why for r in df.orderBy("i").collect()] == [None, "a", "b", "b", None, "c", "keys", "a"]


def test_shapes_work_a_value_out_once(spark):
    df = spark.createDataFrame([(1, json.dumps(STATE))], "session long, json string")
    for shape in (records.CHECKPOINT, records.DELTA, records.FOLD, records.MARK, records.PROVENANCE, records.ANY, shapes.whole(), shapes.entries(shapes.whole(), 3), records.STRINGS(4)):
        plan = df.select(shape(F.try_parse_json("json"), "keys").alias("why"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("parse_json") == 1
