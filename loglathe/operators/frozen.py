"""Projections that go on from the one before: what was sent stays, and only the tail is new.

Bodies and projections have session, pos and item; results of calls have a
call_id.  A peek that an assistant's row follows has been read, and its result
becomes one line, in what was sent as well, so that the change is where the peek
was and nowhere else.  While the body sent before is a prefix of the new one,
its projection is kept as it was, with whatever was put between its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import prefixes

STUB = "Ephemeral peek consumed; the reply that followed it is the surviving trace."


def withdrawn(body: DataFrame) -> DataFrame:
    """The body, columns role and ephemeral read, with consumed peeks as one line and ``consumed``."""
    answered = F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(W.partitionBy("session")) > F.col("pos")
    consumed = F.coalesce((F.col("role") == "toolResult") & F.col("ephemeral") & answered, F.lit(False))
    return body.withColumn("consumed", consumed).withColumn("item", F.when(F.col("consumed"), F.lit(STUB)).otherwise(F.col("item")))


def carried(sent: DataFrame, body: DataFrame) -> DataFrame:
    """What was sent (session, pos, call_id, item), with the peeks that the new body has withdrawn as one line."""
    gone = body.where("consumed and call_id is not null").select("session", "call_id", F.lit(True).alias("gone")).distinct()
    return sent.join(gone, ["session", "call_id"], "left").select("session", "pos", "call_id", F.when(F.col("gone"), F.lit(STUB)).otherwise(F.col("item")).alias("item"))


def frozen(body: DataFrame, sent_body: DataFrame, sent: DataFrame) -> DataFrame:
    """session, pos, item, part: the projection of each session's body.

    ``part`` tells rows that are kept from what was sent, those appended to it,
    and those of sessions that are projected anew.  Nothing is compared item by
    item: prefixes are found by their digests.
    """
    old = carried(sent_body, body)
    lists = old.select("session", F.lit("old").alias("list"), "pos", "item").unionByName(body.select("session", F.lit("new").alias("list"), "pos", "item"))
    pairs = body.select("session").distinct().select("session", F.lit("old").alias("left"), F.lit("new").alias("right"))
    size = sent.groupBy("session").agg(F.count("*").alias("offset"))
    c = prefixes.common(lists, pairs).where("common = left_items").select("session", F.col("left_items").alias("held"))
    kept = c.join(size, "session")  # nothing was sent: nothing is kept
    head = carried(sent, body).join(kept, "session").select("session", "pos", "item", F.lit("kept").alias("part"))
    tail = body.select("session", "pos", "item").join(kept, "session").where("pos >= held").select("session", (F.col("pos") - F.col("held") + F.col("offset")).alias("pos"), "item", F.lit("appended").alias("part"))
    anew = body.select("session", "pos", "item").join(kept, "session", "left_anti").withColumn("part", F.lit("whole"))
    return head.unionByName(tail).unionByName(anew)
