"""Overflow recovery: the rejected answer at a branch's end, the branch without it, and whether a retry can follow.

Columns session, entry, parent, idx, kind ('message' or a record of another
kind), role, error, call and nbytes are read; ``call`` is true where an
assistant's message holds a tool call, ``result`` where a message answers the
nearest call above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import BYTES_PER_TOKEN
from . import trees


def branch_rows(e: DataFrame) -> DataFrame:
    """The rows on each session's branch, with its leaf."""
    return e.join(trees.on_branch(trees.intervals(e)).select("session", "leaf", "entry"), ["session", "entry"])


def overflow_errors(b: DataFrame) -> DataFrame:
    """session, leaf, error_entry, new_leaf, at: branches whose last message is an assistant's error."""
    last = b.where("kind = 'message'").groupBy("session").agg(F.max_by(F.struct("leaf", "entry", "parent", "role", "error", "idx"), "idx").alias("x"))
    return last.where("x.role = 'assistant' and x.error").select("session", "x.leaf", F.col("x.entry").alias("error_entry"), F.col("x.parent").alias("new_leaf"), F.col("x.idx").alias("at"))


def recover(e: DataFrame, b: DataFrame) -> DataFrame:
    """What rolling each rejected answer back abandons, and why the request is not sent again.

    The branch ends at the error's parent afterwards.  A retry is skipped where
    the messages left are not those of before without the error's own
    ('strip'), or where a call of the last answer that counts has no result
    ('unanswered').
    """
    errors = overflow_errors(b)
    rows = b.drop("leaf").join(errors, "session")
    message, kept = F.col("kind") == "message", F.col("idx") < F.col("at")
    counts = message & kept & (F.col("role") == "assistant") & (F.col("call") | ~F.col("error"))
    g = rows.groupBy("session", "leaf", "error_entry", "new_leaf").agg(
        F.count_if(~kept).alias("entries_abandoned"),
        F.coalesce(F.sum(F.when(~kept & message, F.col("nbytes"))), F.lit(0)).alias("bytes"),
        F.count_if(message).alias("messages_before"),
        F.count_if(message & kept).alias("messages_after"),
        F.max_by(F.when(F.col("call"), F.col("entry")), F.when(counts, F.col("idx"))).alias("pending"),
    )
    answers = trees.nearest_above(e, F.col("call") & (F.col("kind") == "message") & (F.col("role") == "assistant"))
    answered = rows.where(message & kept & F.col("result")).select("session", "entry").join(answers, ["session", "entry"]).select("session", F.col("found").alias("pending")).distinct().withColumn("answered", F.lit(True))
    r = g.join(answered, ["session", "pending"], "left")
    holds = F.col("messages_after") == F.col("messages_before") - 1
    unanswered = F.col("pending").isNotNull() & F.col("answered").isNull()
    why = F.when(~holds, "strip").when(unanswered, "unanswered")
    tokens = F.ceil(F.col("bytes") / BYTES_PER_TOKEN).cast("bigint")
    return r.select("session", "error_entry", F.col("leaf").alias("old_leaf"), "new_leaf", "entries_abandoned", tokens.alias("tokens_rolled_back"), "messages_before", "messages_after", holds.alias("holds"), why.isNull().alias("replayed"), why.alias("replay_skip_reason"))
