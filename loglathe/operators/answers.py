"""Answers within windows: from a question to the next one of its chain, the first text that answers.

Rows have session, idx, role and text; questions session, chain, wave, at (the
row that asked, null: never asked) and ids, what is asked.  A window begins
behind its row and ends before the next question's, or with the session where
there is none or it was never asked.  A row lies in the window of the last
question before it, and in earlier ones that nothing ended: those are found from
the questions alone, so that no row meets a window that does not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ledgers import as_of

#: Around what is asked: an answer's line, and a document's heading.
ANSWER, HEADING = (r"(?m)^\s*(?:", r")\s*:\s*(\S.*)$"), (r"(?m)^#+\s*(?:", r")\b(.*)$")


def pattern(ids: Column, around: tuple[str, str] = ANSWER) -> Column:
    """One pattern for any of the ids."""
    quoted = F.transform(ids, lambda x: F.regexp_replace(x, r"([^A-Za-z0-9_-])", r"\\$1"))
    return F.concat(F.lit(around[0]), F.array_join(quoted, "|"), F.lit(around[1]))


def windows(questions: DataFrame) -> DataFrame:
    """The questions that were asked, with ``open``: the next one of the chain never was, or there is none."""
    ahead = F.lead("at").over(W.partitionBy("session", "chain").orderBy("wave"))
    return questions.withColumn("open", ahead.isNull()).where("at is not null")


def candidates(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """session, chain, wave, ids, idx, text, n: an assistant's texts in each window, numbered."""
    w = windows(questions).withColumn("key", F.struct("session", "chain"))
    said = rows.where((F.col("role") == "assistant") & (F.trim("text") != "")).select("session", F.col("idx").cast("bigint").alias("idx"), "text")
    said = said.join(questions.select("session", "chain").distinct(), "session").withColumn("key", F.struct("session", "chain"))
    last = as_of(said, w.select("key", F.col("at").cast("bigint").alias("idx"), "wave"), "idx", "wave", by="key", strict=False).where("found is not null")
    # a question's own row ends the window before it and is not in its own
    own = w.select("key", F.col("wave").alias("found"), "wave", "ids", F.col("at").cast("bigint").alias("behind"))
    earlier = w.where("open").select("key", F.col("wave").alias("early"), "ids").join(w.select("key", F.col("wave").alias("found")), "key").where("early < found").select("key", "found", F.col("early").alias("wave"), "ids", F.lit(-1).cast("bigint").alias("behind"))
    held = last.join(own.unionByName(earlier), ["key", "found"]).where("idx > behind")
    n = F.row_number().over(W.partitionBy("session", "chain", "wave").orderBy("idx"))
    return held.select("session", "chain", "wave", "ids", "idx", "text").withColumn("n", n)


def first_answers(rows: DataFrame, questions: DataFrame, around: tuple[str, str] = ANSWER, fallback: bool = False) -> DataFrame:
    """session, chain, wave, delivered, matched, at, skipped, text: the first text of each window that answers.

    With ``fallback`` the first text of all where none does.  ``skipped`` counts
    the texts before it.
    """
    c = candidates(rows, questions).withColumn("hit", F.rlike("text", pattern(F.col("ids"), around)))
    found = F.struct("idx", "text", "n")
    hit, first = F.min(F.when(F.col("hit"), found)), F.min(found)
    g = c.groupBy("session", "chain", "wave").agg(hit.alias("hit"), first.alias("first"))
    g = g.withColumn("x", F.coalesce("hit", "first") if fallback else F.col("hit"))
    r = questions.select("session", "chain", "wave", F.col("at").isNotNull().alias("delivered")).join(g, ["session", "chain", "wave"], "left")
    return r.select("session", "chain", "wave", "delivered", F.col("hit").isNotNull().alias("matched"), F.col("x.idx").alias("at"), (F.col("x.n") - 1).cast("bigint").alias("skipped"), F.coalesce("x.text", F.lit("")).alias("text"))


def parsed(found: DataFrame, questions: DataFrame, around: tuple[str, str] = ANSWER) -> DataFrame:
    """session, chain, wave, id, answer: what the text says to each thing that was asked, null where it does not."""
    q = questions.select("session", "chain", "wave", F.explode("ids").alias("id")).join(found.select("session", "chain", "wave", "text"), ["session", "chain", "wave"])
    own = pattern(F.array("id"), around)
    return q.select("session", "chain", "wave", "id", F.trim(F.get(F.regexp_extract_all("text", own, F.lit(1)), F.lit(0))).alias("answer"))
