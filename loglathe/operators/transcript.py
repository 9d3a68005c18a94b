"""Structure of transcripts: turns, units, batches, freshness, protection, admission.

A session's rows are numbered by idx; spans are [start, end).  Sizes of spans
are differences of prefix sums, so no span is ever read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..policy import BYTES_PER_TOKEN, Policy
from .ledgers import share

def ORDER():  # noqa: N802
    """A session's rows in order."""
    return W.partitionBy("session").orderBy("idx")


def LATER():  # noqa: N802
    """The rows behind each."""
    return W.partitionBy("session").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
TRAILING = ("custom", "bashExecution")


def with_turns(m: DataFrame) -> DataFrame:
    """Rows with the number of their turn: 0 before the first user row."""
    return m.withColumn("turn", F.count_if(F.col("role") == "user").over(ORDER()))


def segments(m: DataFrame) -> DataFrame:
    """Turns from each user row to the next, complete if the last row that counts ends an answer."""
    t = with_turns(m)
    counted = ~F.col("role").isin(*TRAILING)
    r = t.groupBy("session", "turn").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"), (F.max(F.when(counted, F.col("idx"))) + 1).alias("end"), F.max_by("terminal", F.when(counted, F.col("idx"))).alias("complete"), F.sum("nbytes").alias("nbytes"), F.count("*").alias("n"))
    return r.where("turn > 0")


def complete_turns(m: DataFrame) -> DataFrame:
    return segments(m).where("complete").select("session", "turn", "start", "end")


def leading_continuation(m: DataFrame) -> DataFrame:
    """Sessions that begin with rows before any user: their span, if it ends an answer."""
    r = with_turns(m).where("turn = 0").groupBy("session").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.max_by("terminal", "idx").alias("terminal"), F.min_by("role", "idx").alias("first_role"))
    return r


def closed_units(m: DataFrame) -> DataFrame:
    """Foldable rows of each segment, and of what kind."""
    t = with_turns(m).where("turn > 0")
    kind = F.when(F.col("role") == "assistant", F.when(F.col("terminal"), "answer")).otherwise("row")
    return t.withColumn("kind", kind).where("kind is not null").groupBy("session", "turn", "kind").agg(F.count("*").alias("units"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def unsafe(m: DataFrame) -> DataFrame:
    """Rows of no unit: those before the first segment, and the user row of an unfinished last segment."""
    s = segments(m)
    last = s.withColumn("last", F.max("turn").over(W.partitionBy("session"))).where("turn = last and not complete").select("session", F.col("start").alias("idx"), F.lit("open").alias("why"))
    head = with_turns(m).where("turn = 0").select("session", "idx", F.lit("head").alias("why"))
    return last.unionByName(head)


def fresh_tail(m: DataFrame, policy: Policy) -> DataFrame:
    """Rows behind which less than the fresh bytes lie."""
    later = F.coalesce(F.sum("nbytes").over(LATER()), F.lit(0))
    return m.withColumn("later", later).where(F.col("later") < policy.zone_bytes(policy.fresh_tail)).select("session", "idx", "later")


def fresh_boundary(m: DataFrame, policy: Policy) -> DataFrame:
    """Where the last whole turns begin that hold the fresh bytes, or the first turn."""
    suffix = F.sum("nbytes").over(W.partitionBy("session").orderBy(F.desc("start")))
    r = segments(m).withColumn("suffix", suffix)
    enough = F.col("suffix") >= policy.zone_bytes(policy.fresh_tail)
    return r.groupBy("session").agg(F.coalesce(F.max(F.when(enough, F.col("start"))), F.min("start")).alias("boundary"), F.sum("nbytes").alias("nbytes"))


def current_turn_boundary(m: DataFrame) -> DataFrame:
    return m.groupBy("session").agg(F.max(F.when(F.col("terminal"), F.col("idx"))).alias("boundary"), F.count("*").alias("rows"))


def span_bytes(m: DataFrame, spans: DataFrame) -> DataFrame:
    """Bytes of each span as one JSON list: its rows, commas and brackets."""
    p = m.select("session", "idx", F.sum("nbytes").over(ORDER()).alias("upto"), F.row_number().over(ORDER()).alias("n"), "nbytes")
    a = p.select("session", F.col("idx").alias("start"), (F.col("upto") - F.col("nbytes")).alias("before"), (F.col("n") - 1).alias("n0"))
    b = p.select("session", (F.col("idx") + 1).alias("end"), "upto", F.col("n").alias("n1"))
    r = spans.join(a, ["session", "start"]).join(b, ["session", "end"])
    rows = F.col("n1") - F.col("n0")
    return r.select("session", "start", "end", rows.cast("bigint").alias("rows"), (F.col("upto") - F.col("before") + rows + 1).alias("bytes"))


def linkage(e: DataFrame, call: str = "click", result: str = "view") -> DataFrame:
    """Calls and results of each identifier."""
    r = e.where(F.col("kind").isin(call, result)).groupBy("session", "k").agg(F.count_if(F.col("kind") == call).alias("calls"), F.count_if(F.col("kind") == result).alias("results"))
    return r.withColumn("linked", (F.col("calls") == 1) & (F.col("results") == 1))


def tool_batches(e: DataFrame, call: str = "click", result: str = "view") -> DataFrame:
    """A call's batch: the results that follow without anything between; safe if some do and no other batch has their identifiers."""
    by = W.partitionBy("session").orderBy("ordinal")
    r = e.withColumn("batch", F.last(F.when(F.col("kind") == call, F.col("ordinal")), True).over(by)).withColumn("broken", F.count_if(~F.col("kind").isin(call, result)).over(by))
    own = r.where(F.col("kind") == call).select("session", "batch", F.col("broken").alias("at"))
    results = r.where(F.col("kind") == result).select("session", "batch", "broken", "ordinal", "props", "k")
    j = own.join(results, ["session", "batch"], "left").withColumn("inside", F.col("broken") == F.col("at"))
    inside = lambda c: F.when(F.col("inside"), c)
    g = j.groupBy("session", "batch").agg(F.count(inside(F.lit(1))).alias("results"), F.countDistinct(inside(F.col("k"))).alias("ids"), F.coalesce(F.sum(inside(F.octet_length("props").cast("bigint"))), F.lit(0)).alias("nbytes"), F.max(inside(F.col("ordinal"))).alias("last"))
    return g.withColumn("complete", (F.col("results") > 0) & (F.col("results") == F.col("ids")))


def unique_anchor(m: DataFrame) -> DataFrame:
    """Digests that exactly one row has, with that row."""
    r = m.withColumn("sha", F.sha2("text", 256)).groupBy("sha").agg(F.count("*").alias("n"), F.min("session").alias("session"), F.min("idx").alias("idx"))
    return r.where("n = 1").drop("n")


def aligned(window: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of a window paired with the rows of the log that have the same digest, in order: the n-th with the n-th."""
    key = W.partitionBy("session", "sha").orderBy("idx")
    number = lambda df: df.withColumn("sha", F.sha2("text", 256)).withColumn("n", F.row_number().over(key))
    a, b = number(window).select("session", "sha", "n", "idx"), number(log).select("session", "sha", "n", F.col("idx").alias("entry"))
    return a.join(b, ["session", "sha", "n"], "left").select("session", "idx", "entry", F.col("entry").isNull().alias("protected"))


def protected_mass(m: DataFrame, policy: Policy, pinned: str = "custom") -> DataFrame:
    """Bytes and rows that are pinned, and those of them that would be stale."""
    later = F.coalesce(F.sum("nbytes").over(LATER()), F.lit(0))
    r = m.withColumn("stale", later >= policy.zone_bytes(policy.fresh_tail)).withColumn("pin", F.col("role") == pinned)
    mass = lambda c: F.sum(F.when(c, F.col("nbytes")).otherwise(0))
    return r.groupBy("session").agg(F.count_if("pin").alias("pinned"), mass(F.col("pin")).alias("pinned_bytes"), F.count_if(F.col("pin") & F.col("stale")).alias("stale"), mass(F.col("pin") & F.col("stale")).alias("stale_bytes"))


def remainder(t: DataFrame, claimed: str = "purchase", limit: int = 3) -> DataFrame:
    """What no mark claims: bytes, share, and the largest results of each session."""
    free = F.col("tool") != claimed
    r = t.withColumn("free", free).withColumn("rank", F.row_number().over(W.partitionBy("session", "free").orderBy(F.desc("tokens"), "ordinal")))
    whole = W.partitionBy("session")
    r = r.withColumn("free_bytes", F.sum(F.when(F.col("free"), F.col("nbytes")).otherwise(0)).over(whole)).withColumn("all_bytes", F.sum("nbytes").over(whole))
    return r.where(F.col("free") & (F.col("rank") <= limit)).select("session", "rank", "ordinal", "tokens", "free_bytes", share(F.col("free_bytes"), F.col("all_bytes")).alias("free_share"))


def occupancy(m: DataFrame, policy: Policy) -> DataFrame:
    """Each session's occupancy and the band in which it lies."""
    used = F.ceil(F.sum("nbytes") / BYTES_PER_TOKEN).cast("bigint")
    r = m.groupBy("session").agg(used.alias("tokens"))
    x = F.col("occupancy")
    band = F.when(x >= policy.prepare_ratio, "fence").when(x >= policy.refold_ratio, "backstop").when(x >= policy.max_target, "due").when(x >= policy.min_target, "working").otherwise("free")
    return r.withColumn("occupancy", share(F.col("tokens"), F.lit(policy.budget_tokens))).withColumn("band", band)


def admission(m: DataFrame, policy: Policy) -> DataFrame:
    """Whether each row fits what the rows before leave of the budget."""
    cost = F.ceil(F.col("nbytes") / BYTES_PER_TOKEN).cast("bigint")
    before = F.coalesce(F.sum("cost").over(ORDER().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = m.withColumn("cost", cost).withColumn("headroom", F.lit(policy.budget_tokens) - before)
    return r.select("session", "idx", "cost", "headroom", (F.col("cost") <= F.col("headroom")).alias("admitted"))


def budgets(m: DataFrame, window: int) -> DataFrame:
    """Capacity of each session: window, serving budget, reservation, used, headroom."""
    from ..policy import serving_budget

    budget = serving_budget(window)
    used = F.ceil(F.sum("nbytes") / BYTES_PER_TOKEN).cast("bigint")
    return m.groupBy("session").agg(used.alias("used")).select("session", "used", F.lit(window).cast("bigint").alias("window"), F.lit(budget).cast("bigint").alias("budget"), F.lit(window - budget).cast("bigint").alias("reserved"), (budget - F.col("used")).alias("headroom"))
