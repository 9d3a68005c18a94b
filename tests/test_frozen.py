"""Projections that go on from the one before."""

from __future__ import annotations

from loglathe.operators import frozen

BODY = "session int, pos long, role string, call_id string, ephemeral boolean, item string"
SENT = "session int, pos long, call_id string, item string"


def test_prefix_is_kept_and_tail_appended(spark):
    body = [
        (1, 0, "user", None, None, "a"), (1, 1, "toolResult", "c1", True, "peek"), (1, 2, "assistant", None, None, "b"), (1, 3, "toolResult", "c2", True, "late"), (1, 4, "toolResult", "c3", False, "kept"),
        (2, 0, "user", None, None, "x"), (2, 1, "assistant", None, None, "y"),
        (3, 0, "user", None, None, "n"),
        (4, 0, "user", None, None, "short"),
    ]
    new = frozen.withdrawn(spark.createDataFrame(body, BODY))
    assert {(r.session, r.pos) for r in new.where("consumed").collect()} == {(1, 1)}
    old = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "c1", "peek"), (2, 0, None, "other"), (4, 0, None, "short"), (4, 1, None, "gone")], SENT)
    sent = spark.createDataFrame([(1, 0, None, "a"), (1, 1, None, "carrier"), (1, 2, "c1", "peek"), (2, 0, None, "other"), (4, 0, None, "short"), (4, 1, None, "gone")], SENT)
    got = sorted(tuple(r) for r in frozen.frozen(new, old, sent).collect())
    assert got == [
        (1, 0, "a", "kept"), (1, 1, "carrier", "kept"), (1, 2, frozen.STUB, "kept"), (1, 3, "b", "appended"), (1, 4, "late", "appended"), (1, 5, "kept", "appended"),
        (2, 0, "x", "whole"), (2, 1, "y", "whole"), (3, 0, "n", "whole"), (4, 0, "short", "whole"),
    ]
