"""Roll-ups of probes: margins, blocks, judges, cache repetitions; audits of exchanges; snapping of spans and fuller briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from .ledgers import BY, share
from .spans import held


def by_kind(e: DataFrame) -> DataFrame:
    """Events of each kind, null a kind of its own, with dense sequence numbers checked."""
    return e.groupBy(F.coalesce("kind", F.lit("null")).alias("kind")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def alternation(e: DataFrame, request: str = "view", response: str = "click") -> DataFrame:
    """Requests and responses that do not alternate, for each session."""
    r = e.where(F.col("kind").isin(request, response)).withColumn("before", F.lag("kind").over(BY()))
    wrong = F.when(F.col("before").isNull(), F.col("kind") == response).otherwise(F.col("kind") == F.col("before"))
    return r.groupBy("session").agg(F.count("*").alias("records"), F.count_if(wrong).alias("violations"), F.min(F.when(wrong, F.col("ordinal"))).alias("first_violation"))


def heartbeats(e: DataFrame, bound_ms: int) -> DataFrame:
    """The longest silence of each session, its end included, and whether it keeps the bound."""
    end = e.agg(F.max("wall_ms").alias("end"))
    gap = F.lead("wall_ms").over(BY()) - F.col("wall_ms")
    r = e.crossJoin(F.broadcast(end)).withColumn("gap", F.coalesce(gap, F.col("end") - F.col("wall_ms")))  # one row
    return r.groupBy("session").agg(F.max("gap").alias("longest"), F.count_if(F.col("gap") > bound_ms).alias("breaks")).withColumn("kept", F.col("breaks") == 0)


def newest(e: DataFrame, kind: str, keep: int = 3) -> DataFrame:
    """The newest few records of a kind in each session, newest last."""
    r = e.where(F.col("kind") == kind).withColumn("age", F.row_number().over(W.partitionBy("session").orderBy(F.desc("ordinal"))))
    return r.where(F.col("age") <= keep).select("session", "ordinal", "k", "age")


def margins(a: DataFrame) -> DataFrame:
    """Margin of each vector's own label over the mean of the others, and its sigmoid."""
    own = F.col("candidate") == F.col("label")
    g = a.groupBy("vec_id", "label").agg(F.max(F.when(own, F.col("score"))).alias("own"), F.avg(F.when(~own, F.col("score"))).alias("others"))
    m = F.round(F.col("own") - F.col("others"), 6)
    return g.select("vec_id", "label", m.alias("margin"), F.round(X.sigmoid(m), 5).alias("p"), (m > 0).alias("retrieve"))


def blocks(t: DataFrame, size: int) -> DataFrame:
    """Texts tiled into blocks of a fixed number of characters: number, start and end."""
    n = F.ceil(F.length("text") / size).cast("int")
    r = t.where(F.length("text") > 0).select("id", F.length("text").alias("length"), F.posexplode(F.sequence(F.lit(0), n - 1)).alias("pos", "block"))
    return r.select("id", F.col("block").alias("block"), (F.col("block") * size).alias("start"), F.least((F.col("block") + 1) * size, F.col("length")).alias("end"))


def combined_ratios(t: DataFrame, size: int) -> DataFrame:
    """Each text's share of blanks over its blocks, weighted by the blocks' lengths."""
    b = blocks(t, size).join(t, "id")
    part = F.expr("substring(text, start + 1, end - start)")
    blanks = F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
    n = F.col("end") - F.col("start")
    r = b.select("id", n.alias("n"), (blanks / n).alias("ratio"))
    return r.groupBy("id").agg(F.count("*").alias("blocks"), F.round(F.sum(F.col("ratio") * F.col("n")) / F.sum("n"), 6).alias("ratio"))


def judged(e: DataFrame) -> DataFrame:
    """Pairs of neighbouring answers of a kind read forwards and backwards: agreed, or undecided."""
    key = W.partitionBy("session", "kind").orderBy("ordinal")
    r = e.withColumn("other", F.lead("k").over(key)).where("other is not null")
    forward = F.when(F.col("k") >= F.col("other"), F.col("k")).otherwise(F.col("other"))
    backward = F.when(F.col("other") > F.col("k"), F.col("other")).otherwise(F.col("k"))
    decided = (forward == backward) & (F.col("k") != F.col("other"))
    return r.groupBy("kind").agg(F.count("*").alias("pairs"), F.count_if(decided).alias("decided"), F.count_if(~decided).alias("undecided"))


def repetitions(p: DataFrame) -> DataFrame:
    """Reads of the cache by kind side by side for each session, and how the session behaved."""
    r = p.groupBy("session").pivot("kind", ["click", "view", "purchase"]).agg(F.sum("cache_read")).fillna(0)
    cls = F.when((F.col("click") == 0) & (F.col("view") == 0), "cold").when(F.col("click") > F.col("view"), "branch-hit").when(F.col("purchase") > F.col("view"), "suffix-hit").otherwise("shared")
    return r.select("session", "click", "view", "purchase", cls.alias("outcome"))


def repetition_summary(p: DataFrame) -> DataFrame:
    r = repetitions(p)
    return r.groupBy("outcome").agg(F.count("*").alias("sessions"), share(F.sum("click"), F.sum(F.col("click") + F.col("view") + F.col("purchase"))).alias("click_share"))


def snapped(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Spans (session, at, to) moved outwards to the turns that they touch, and how many turns that is."""
    j = spans.join(turns, "session").where("start < to and end > at")
    return j.groupBy("session", "at", "to").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("turns")).withColumn("moved", (F.col("at") != F.col("start")) | (F.col("to") != F.col("end")))


def wedges(m: DataFrame, folds: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows right before a fold, up to so many bytes, that no other fold has: they join it."""
    before = m.select("session", (F.col("idx") + 1).alias("start"), "idx", "nbytes", "role")
    covered = folds.select("session", F.col("end").alias("start")).withColumn("next_to", F.lit(1))
    r = folds.select("session", "turn", "start").join(before, ["session", "start"]).join(covered, ["session", "start"], "left").where((F.col("nbytes") <= limit_bytes) & F.col("next_to").isNull())
    return r.select("session", "turn", "idx", "role", F.col("nbytes").alias("wedge_bytes"))


def chapter_briefs(m: DataFrame, chapters: DataFrame, cap: int = 200) -> DataFrame:
    """What users asked in each chapter, in order, then how its answers end, as far as the cap goes."""
    spans = chapters.select("session", "start", "end").withColumn("begin", F.col("start")).withColumn("stop", F.col("end"))
    r = held(m.select("session", "idx", "role", "text"), spans, "begin", "stop").withColumnsRenamed({"begin": "start", "stop": "end"})
    piece = F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.left(X.one_line(F.col("text")), F.lit(40)))).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), F.right(X.one_line(F.col("text")), F.lit(40))))
    r = r.withColumn("piece", piece).where("piece is not null")
    by = W.partitionBy("session", "start").orderBy("idx")
    r = r.withColumn("upto", F.sum(F.length("piece") + 3).over(by) - 3).where(F.col("upto") <= cap)
    g = r.groupBy("session", "start", "end").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("x"))
    return g.select("session", "start", "end", F.array_join(F.transform("x", lambda v: v["piece"]), " · ").alias("brief"))
