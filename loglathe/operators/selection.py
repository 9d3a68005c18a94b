"""What to fold next: batches, chapters, consolidations, top-ups, and accounts of marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..policy import BYTES_PER_TOKEN, PLACEHOLDER_BYTES, Policy
from ..storage import discard, stored
from . import transcript as T
from .ledgers import as_of, share


def turn_folds(m: DataFrame) -> DataFrame:
    """A fold for each complete turn: span, bytes, and what folding it frees."""
    s = T.segments(m).where("complete")
    freed = F.greatest(F.col("nbytes") - PLACEHOLDER_BYTES, F.lit(0))
    return s.select("session", "turn", "start", "end", "nbytes", freed.alias("freed"))


def oldest_batch(b: DataFrame, least: int) -> DataFrame:
    """The first complete batch of each session with enough bytes."""
    first = F.row_number().over(W.partitionBy("session").orderBy("batch")) == 1
    return b.where(F.col("complete") & (F.col("nbytes") >= least)).withColumn("first", first).where("first").select("session", "batch", "last", "results", "nbytes")


def chapter(m: DataFrame, policy: Policy) -> DataFrame:
    """The first turn from which adjacent complete turns fit a chapter, and the longest such run.

    A chapter has few turns at most, so a row looks at that many behind it.
    """
    by = W.partitionBy("session").orderBy("turn")
    t = turn_folds(m).select("session", "turn", "start", "end", "nbytes", F.sum("nbytes").over(by).alias("upto"))

    def run(k: int):
        to, size = F.lead("turn", k).over(by), F.lead("upto", k).over(by) - F.col("upto") + F.col("nbytes")
        fits = (to == F.col("turn") + k) & size.between(policy.min_chapter_chars, policy.max_chapter_chars)
        return F.when(fits, F.struct(to.alias("to"), F.lead("end", k).over(by).alias("stop"), size.alias("bytes")))

    best = t.withColumn("x", F.array_max(F.array(*(run(k) for k in range(policy.max_chapter_turns))))).where("x is not null")
    first = F.row_number().over(W.partitionBy("session").orderBy("start")) == 1
    return best.withColumn("first", first).where("first").select("session", "turn", "start", F.col("x.to").alias("to"), F.col("x.stop").alias("end"), F.col("x.bytes").alias("bytes"))


def consolidations(m: DataFrame, policy: Policy, pinned_from: int = 800) -> DataFrame:
    """Full groups of adjacent folds, none of them pinned (folds from so many bytes are)."""
    by = W.partitionBy("session").orderBy("turn")
    t = turn_folds(m).where(F.col("nbytes") < pinned_from)
    t = t.withColumn("run", F.col("turn") - F.row_number().over(by))
    t = t.withColumn("part", F.floor((F.row_number().over(W.partitionBy("session", "run").orderBy("turn")) - 1) / policy.consolidate_after))
    g = t.groupBy("session", "run", "part").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("nbytes").alias("nbytes"))
    return g.where(F.col("n") == policy.consolidate_after).select("session", "start", "end", "nbytes")


def refold(m: DataFrame, expanded_to: int = 400) -> DataFrame:
    """The expanded fold (of few bytes) that ends first, the shortest of these."""
    r = turn_folds(m).where(F.col("nbytes") <= expanded_to)
    first = F.row_number().over(W.partitionBy("session").orderBy("end", F.col("end") - F.col("start"))) == 1
    return r.withColumn("first", first).where("first").select("session", "turn", "start", "end")


def top_up(m: DataFrame, policy: Policy, target: float) -> DataFrame:
    """Oldest folds until the freed share of the budget reaches the target; the one that crosses it counts."""
    by = W.partitionBy("session").orderBy("start")
    r = turn_folds(m).withColumn("before", F.coalesce(F.sum("freed").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return r.where(F.col("before") < policy.zone_bytes(target)).select("session", "turn", "start", "freed", (F.col("before") + F.col("freed")).alias("upto"))


def rungs(m: DataFrame, batches: DataFrame, policy: Policy) -> DataFrame:
    """The rung of the ladder on which each session stands."""
    groups = consolidations(m, policy).groupBy("session").agg(F.count("*").alias("groups"))
    chapters = chapter(m, policy).select("session", F.lit(1).alias("chapter"))
    folds = refold(m).select("session", F.lit(1).alias("refold"))
    tools = batches.where("complete").groupBy("session").agg(F.count("*").alias("tools"))
    r = T.occupancy(m, policy).join(groups, "session", "left").join(chapters, "session", "left").join(folds, "session", "left").join(tools, "session", "left")
    x = F.col("occupancy")
    rung = F.when(F.col("tools") > 0, "tool").when((x >= policy.refold_ratio) & F.col("refold").isNotNull(), "refold").when(F.col("groups") > 0, "consolidation").when((x >= policy.prepare_ratio) & F.col("chapter").isNotNull(), "chapter").when(F.col("chapter").isNotNull(), "chapter-prepare").otherwise("none")
    return r.select("session", "occupancy", rung.alias("rung"))


def split_by_size(m: DataFrame, cap: int) -> DataFrame:
    """Pieces of a session's rows in order, each up to ``cap`` bytes, a larger row alone.

    Sums of prefixes give for every row where the next piece would begin if one
    began with it; the pieces are what is reached from the first row, found by
    doubling those steps: a row for each row, in as many rounds as the logarithm
    of the most pieces.
    """
    by = W.partitionBy("session").orderBy("idx")
    r = m.select("session", "idx", "nbytes", F.row_number().over(by).cast("bigint").alias("n"), F.sum("nbytes").over(by).cast("bigint").alias("upto"))
    r = stored(r.withColumn("before", F.col("upto") - F.col("nbytes")), "rows")
    ends = r.groupBy("session", F.col("upto").alias("at")).agg(F.min("n").alias("n"))
    starts = r.select("session", "n", "before", F.col("before").alias("at"))
    # the first row that does not fit, but at least the one behind the first that has bytes
    some = as_of(starts, ends.withColumnRenamed("n", "first"), "at", "first", forward=True).select("session", "n", "before", F.col("found").alias("filled"))
    over = as_of(some.withColumn("at", F.col("before") + cap), ends.withColumnRenamed("n", "first"), "at", "first", forward=True)
    last = r.groupBy("session").agg(F.max("n").alias("last"))
    jump = over.select("session", "n", F.greatest("found", F.col("filled") + 1).alias("to"), F.col("found")).join(last, "session")
    jump = stored(jump.select("session", "n", F.when(F.col("found").isNotNull() & (F.col("to") <= F.col("last")), F.col("to")).alias("to")), "jumps")
    reached = stored(r.where("n = 1").select("session", "n"), "reached")
    while True:
        more = stored(reached.join(jump, ["session", "n"]).where("to is not null").select("session", F.col("to").alias("n")), "more")
        if more.isEmpty():
            break
        farther = jump.select("session", F.col("n").alias("to"), F.col("to").alias("next"))
        past = reached, more, jump
        reached = stored(reached.unionByName(more).distinct(), "reached")
        jump = stored(jump.where("to is not null").join(farther, ["session", "to"]).select("session", "n", F.col("next").alias("to")), "jumps")
        for table in past:
            discard(table)
    begins = reached.withColumn("begins", F.lit(1))
    p = r.join(begins, ["session", "n"], "left").withColumn("piece", (F.count("begins").over(by) - 1).cast("bigint"))
    return p.groupBy("session", "piece").agg(F.min("idx").cast("bigint").alias("start"), (F.max("idx") + 1).cast("bigint").alias("end"), F.sum("nbytes").alias("nbytes"))


def mark_accounts(m: DataFrame, policy: Policy) -> DataFrame:
    """Marks on all turn folds: bytes freed, of them in stale rows, shares, and what a rewrite from the first mark sends again."""
    later = F.coalesce(F.sum("nbytes").over(W.partitionBy("session").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    f = turn_folds(m).withColumn("eligible", later >= policy.zone_bytes(policy.fresh_tail))
    first = f.groupBy("session").agg(F.count("*").alias("marks"), F.count_if("eligible").alias("eligible"), F.sum("freed").alias("freed"), F.sum(F.when(F.col("eligible"), F.col("freed")).otherwise(0)).alias("eligible_freed"), F.min("start").alias("start"))
    suffix = m.join(first.select("session", "start"), "session").where("idx >= start").groupBy("session").agg(F.ceil(F.sum("nbytes") / BYTES_PER_TOKEN).cast("bigint").alias("rewrite_tokens"))
    return first.join(suffix, "session").select("session", "marks", "eligible", "freed", "eligible_freed", share(F.col("freed"), F.lit(policy.zone_bytes(1.0))).alias("freed_share"), "rewrite_tokens")


def mark_eligibility(m: DataFrame, policy: Policy) -> DataFrame:
    """Each mark: protected by the fresh tail, unfulfillable without anything to free, or eligible."""
    b = T.fresh_boundary(m, policy).select("session", "boundary")
    r = turn_folds(m).join(b, "session")
    state = F.when(F.col("freed") == 0, "unfulfillable").when(F.col("end") > F.col("boundary"), "protected").otherwise("eligible")
    return r.select("session", "turn", state.alias("state"))


def guard_waivers(m: DataFrame, policy: Policy) -> DataFrame:
    """How many guarded marks may be waived: all at the fence, all but two of four or more under pressure without other work."""
    e = mark_eligibility(m, policy).groupBy("session").agg(F.count_if(F.col("state") == "protected").alias("guarded"), F.count_if(F.col("state") == "eligible").alias("other"))
    r = e.join(T.occupancy(m, policy).select("session", "occupancy"), "session")
    x = F.col("occupancy")
    n = F.when(x >= policy.prepare_ratio, F.col("guarded")).when((F.col("guarded") >= 4) & (F.col("other") == 0) & (x >= policy.refold_ratio), F.greatest(F.col("guarded") - 2, F.lit(1))).otherwise(0)
    return r.select("session", "guarded", "other", n.cast("bigint").alias("waived"))
