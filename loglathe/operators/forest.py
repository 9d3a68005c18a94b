"""Session trees and fold forests: projections, briefs, recovery.

Session trees are read by intervals (``trees``).  Fold forests have three levels,
so that their closure by pointer doubling has three rows a fold at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from ..policy import PLACEHOLDER_BYTES
from . import selection as S
from . import trees
from .containment import contained
from .spans import covering, held

BRIEF = 80


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """node, above, distance: all ancestors up to ``depth`` links, each node its own at 0; from columns node, parent."""
    step = edges.where("parent is not null").select("node", F.col("parent").alias("above"))
    found = edges.select("node", F.col("node").alias("above"), F.lit(0).cast("bigint").alias("distance"))
    for i in range(math.ceil(math.log2(depth + 1))):
        up = found.select(F.col("node").alias("above"), F.col("above").alias("top"), (F.col("distance") + (1 << i)).alias("distance"))
        found = found.unionByName(step.join(up, "above").select("node", F.col("top").alias("above"), "distance"))
        step = step.join(step.select(F.col("node").alias("above"), F.col("above").alias("top")), "above").select("node", F.col("top").alias("above"))
    return found


def branch(e: DataFrame) -> DataFrame:
    """The root path of each session's last entry."""
    return trees.on_branch(trees.intervals(e)).select("session", "leaf", "entry", "distance")


def dead_entries(e: DataFrame) -> DataFrame:
    return e.join(branch(e).select("session", "entry"), ["session", "entry"], "left_anti").select("session", "entry", "idx", "role")


def descends(e: DataFrame) -> DataFrame:
    """How many entries descend from each."""
    return trees.descendants(e)


# ------------------------------------------------------------------- forest
def folds(m: DataFrame) -> DataFrame:
    """Three levels for each session: complete turns, chapters of two turns, one consolidation of all.

    A turn's row brings those of the chapter and of the session that begin with
    it: all come from one pass over the turns in order.
    """
    t = S.turn_folds(m).select("session", "turn", "start", "end", "nbytes")
    by, whole = W.partitionBy("session").orderBy("turn"), W.partitionBy("session")
    t = t.withColumn("i", F.row_number().over(by) - 1).withColumn("mate", F.lead(F.struct("start", "end", "nbytes")).over(by))
    t = t.withColumn("all", F.struct(F.min("start").over(whole).alias("start"), F.max("end").over(whole).alias("end"), F.sum("nbytes").over(whole).alias("nbytes")))
    name = lambda kind, *cols: F.concat_ws("-", F.lit(kind), "session", *cols)
    first = F.col("i") % 2 == 0
    root, chapter = name("all"), name("chapter", F.floor(F.col("i") / 2))
    opens = first & F.col("mate").isNotNull()

    def fold(own, kind: str, parent, x=None):
        at = (lambda c: F.col(c)) if x is None else (lambda c: x[c])
        return F.struct(own.alias("fold"), F.lit(kind).alias("kind"), parent.alias("parent"), at("start").alias("start"), at("end").alias("end"), at("nbytes").alias("nbytes"))

    size, other = F.col("nbytes"), F.col("mate.nbytes")
    both = F.struct(F.least("start", "mate.start").alias("start"), F.greatest("end", "mate.end").alias("end"), F.coalesce(size + other, size, other).alias("nbytes"))
    turns = fold(name("turn", "turn"), "turn", F.when(first & F.col("mate").isNull(), root).otherwise(chapter))
    chapters = F.when(opens, fold(chapter, "chapter", root, both))
    alls = F.when(F.col("i") == 0, fold(root, "all", F.lit(None).cast("string"), F.col("all")))
    return t.select("session", F.explode(F.array(turns, chapters, alls)).alias("x")).where("x is not null").select("session", "x.*")


def flatten_refs(m: DataFrame, f: DataFrame) -> DataFrame:
    """Each fold's leaf rows in order: turns own rows, others what is below them."""
    a = ancestors(f.select(F.col("fold").alias("node"), "parent"), 3)
    t = f.where("kind = 'turn'").select("session", F.col("fold").alias("node"), "start", "end")
    rows = held(m.select("session", "idx"), t, "node")
    r = a.join(rows, "node").select("session", F.col("above").alias("fold"), "idx")
    return r.withColumn("position", F.row_number().over(W.partitionBy("fold").orderBy("idx")))


def tree(f: DataFrame) -> DataFrame:
    """Depth, children and leaves of each fold, and its place in a walk from the roots."""
    a = ancestors(f.select(F.col("fold").alias("node"), "parent"), 3)
    depth = a.groupBy("node").agg(F.max("distance").alias("depth"))
    below = a.join(f.select(F.col("fold").alias("node"), "kind"), "node").groupBy("above").agg((F.count("*") - 1).alias("descendants"), F.count_if(F.col("kind") == "turn").alias("leaves"))
    r = f.join(depth.withColumnRenamed("node", "fold"), "fold").join(below.withColumnRenamed("above", "fold"), "fold")
    order = W.partitionBy("session").orderBy("start", "depth")
    return r.select("session", "fold", "kind", "depth", "descendants", "leaves", F.row_number().over(order).alias("position"))


def navigation(f: DataFrame) -> DataFrame:
    by = W.partitionBy("session", "parent").orderBy("start")
    return f.select("session", "fold", F.lag("fold").over(by).alias("previous"), F.lead("fold").over(by).alias("next"))


def violations(f: DataFrame, m: DataFrame) -> DataFrame:
    """What breaks a forest: rows that several turns own, unknown parents, children outside of their parent, repeated folds."""
    own = f.where("kind = 'turn'").select("session", "fold", "start", "end").join(m.select("session", "idx"), "session").where("idx >= start and idx < end")
    shared = own.groupBy("session", "idx").agg(F.count("*").alias("n")).where("n > 1").groupBy("session").agg(F.count("*").alias("n")).select("session", F.lit("shared row").alias("what"), "n")
    p = f.select(F.col("fold").alias("parent"), F.col("start").alias("a"), F.col("end").alias("b")).dropDuplicates(["parent"])
    j = f.where("parent is not null").join(p, "parent", "left")
    lost = j.where("a is null").groupBy("session").agg(F.count("*").alias("n")).select("session", F.lit("unknown parent").alias("what"), "n")
    outside = j.where("start < a or end > b").groupBy("session").agg(F.count("*").alias("n")).select("session", F.lit("outside of parent").alias("what"), "n")
    twice = f.groupBy("session", "fold").count().where("count > 1").groupBy("session").agg(F.count("*").alias("n")).select("session", F.lit("repeated fold").alias("what"), "n")
    return shared.unionByName(lost).unionByName(outside).unionByName(twice)


def visible(f: DataFrame, expand_from: int) -> DataFrame:
    """Topmost collapsed folds: roots of so many bytes are expanded, and chapters of half as many.

    A fold's chapter and root are in its session, so windows find them: a join
    on the parent would send all roots, which have none, to one task.
    """
    chapter = F.when(F.col("kind") == "turn", F.col("parent")).otherwise(F.col("fold"))
    most = lambda kind, by: F.max(F.when(F.col("kind") == kind, F.col("nbytes"))).over(by)
    r = f.withColumn("chapter", chapter)
    r = r.withColumn("chapter_bytes", most("chapter", W.partitionBy("session", "chapter"))).withColumn("root_bytes", most("all", W.partitionBy("session")))
    root, opened = F.col("root_bytes") >= expand_from, F.col("chapter_bytes") >= expand_from // 2
    inside = (F.col("kind") == "turn") & F.col("parent").startswith("chapter-")
    shown = F.col("parent").isNull() | root & (~inside | opened)
    own = F.when(F.col("kind") == "all", root).when(F.col("kind") == "chapter", opened).otherwise(False)
    return r.where(shown & ~own).select("session", "fold", "kind", "start", "end", "nbytes")


def projection(m: DataFrame, v: DataFrame) -> DataFrame:
    """What a session shows: collapsed folds in place of their rows, and the other rows."""
    raw = covering(m.select("session", "idx", "nbytes"), v, "fold").where("fold is null").select("session", F.col("idx").alias("place"), F.lit("row").alias("kind"), F.lit(None).cast("string").alias("fold"), "nbytes")
    stubs = v.select("session", F.col("start").alias("place"), F.col("kind"), "fold", F.lit(PLACEHOLDER_BYTES + BRIEF).cast("bigint").alias("nbytes"))
    return raw.unionByName(stubs)


def projection_summary(m: DataFrame, v: DataFrame) -> DataFrame:
    """Rows and bytes of each session before and after folding."""
    p = projection(m, v).groupBy("session").agg(F.count("*").alias("shown"), F.count("fold").alias("folded"), F.sum("nbytes").alias("shown_bytes"))
    return m.groupBy("session").agg(F.count("*").alias("rows"), F.sum("nbytes").alias("bytes")).join(p, "session").withColumn("saved", F.col("bytes") - F.col("shown_bytes"))


def linkage_check(m: DataFrame, v: DataFrame) -> DataFrame:
    """User rows and answers of each turn before and after: both shown, both hidden, or split."""
    from .transcript import with_turns

    shown = projection(m, v).where("fold is null").select("session", F.col("place").alias("idx"), F.lit(1).alias("shown"))
    r = with_turns(m).where("turn > 0 and role in ('user', 'assistant')").join(shown, ["session", "idx"], "left")
    t = r.groupBy("session", "turn").agg(F.count("*").alias("n"), F.count("shown").alias("s"))
    return t.groupBy("session").agg(F.count_if(F.col("s") == F.col("n")).alias("kept"), F.count_if(F.col("s") == 0).alias("hidden"), F.count_if((F.col("s") > 0) & (F.col("s") < F.col("n"))).alias("split"))


def _brief(first, answers, n):
    return F.concat(F.lit("User: "), X.bounded_subject(X.one_line(first), BRIEF), F.lit(" · Assistant: "), answers.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" rows"))


def briefs(m: DataFrame, v: DataFrame) -> DataFrame:
    """A deterministic brief for each of disjoint folds: how it opens and how many answers it holds."""
    r = held(m.select("session", "idx", "role", "text"), v, "fold", "kind")
    g = r.groupBy("session", "fold", "kind").agg(F.min_by("text", "idx").alias("first"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count("*").alias("n"))
    return g.select("session", "fold", _brief(F.col("first"), F.col("answers"), F.col("n")).alias("brief"))


def briefs_of(m: DataFrame, f: DataFrame) -> DataFrame:
    """The briefs of all folds of a forest: sums of prefixes at their ends, and the first row's text."""
    by = W.partitionBy("session").orderBy("idx")
    p = m.select("session", "idx", "text", F.row_number().over(by).cast("bigint").alias("n"), F.count_if(F.col("role") == "assistant").over(by).alias("answers"), (F.col("role") == "assistant").cast("bigint").alias("own"))
    a = p.select("session", F.col("idx").alias("start"), "text", (F.col("n") - 1).alias("n0"), (F.col("answers") - F.col("own")).alias("a0"))
    b = p.select("session", (F.col("idx") + 1).alias("end"), F.col("n").alias("n1"), F.col("answers").alias("a1"))
    r = f.select("session", "fold", "start", "end").join(a, ["session", "start"]).join(b, ["session", "end"])
    return r.select("session", "fold", _brief(F.col("text"), F.col("a1") - F.col("a0"), F.col("n1") - F.col("n0")).alias("brief"))


def carriage(m: DataFrame, v: DataFrame) -> DataFrame:
    """Where each session's facts (what its users' rows open with) can be seen: raw, in a brief, or only recovered."""
    line = X.one_line(F.col("text"))
    facts = m.where("role = 'user'").select("session", F.col("idx").alias("at"), F.left(line, F.lit(30)).alias("value")).where("length(value) >= 10")
    rows = covering(m.select("session", "idx", "text"), v, "fold").where("fold is null").select("session", F.lit("raw").alias("item"), line.alias("text"))
    told = briefs(m, v).select("session", F.lit("brief").alias("item"), F.col("brief").alias("text"))
    hits = contained(rows.unionByName(told), facts.withColumnRenamed("at", "fact"))
    g = hits.groupBy("session", F.col("fact").cast("int").alias("at")).agg(F.max("item").alias("item"))
    r = facts.join(g, ["session", "at"], "left")
    return r.select("session", "at", F.when(F.col("item") == "raw", "visible-raw").when(F.col("item") == "brief", "visible-brief").otherwise("recoverable").alias("class"))


def recovered(m: DataFrame, f: DataFrame) -> DataFrame:
    """The digest of what each fold recovers: its leaf rows in order, each by its own digest."""
    r = flatten_refs(m, f).join(m.select("session", "idx", F.sha2("text", 256).alias("sha"), "nbytes"), ["session", "idx"])
    return r.groupBy("fold").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sha"))), lambda x: x["sha"]), ","), 256).alias("sha"), F.count("*").alias("rows"), F.sum("nbytes").alias("nbytes"))


def source_map(m: DataFrame, v: DataFrame) -> DataFrame:
    """The fold that shows for each row; none: the row itself."""
    return covering(m.select("session", "idx"), v, "fold")


def slate(v: DataFrame, limit: int = 16) -> DataFrame:
    """The first folds that could be offered, with what expanding costs and folding saves."""
    by = W.partitionBy("session").orderBy("start")
    r = v.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    cost = F.ceil(F.col("nbytes") / 4).cast("bigint")
    stub = PLACEHOLDER_BYTES + BRIEF
    return r.select("session", "rank", "fold", cost.alias("expansion"), F.round(F.greatest(F.lit(0), 1 - stub / F.col("nbytes").cast("double")), 4).alias("saved_share"))


def fair_shares(m: DataFrame, f: DataFrame, budget: int = 300) -> DataFrame:
    """A consolidation's budget dealt to its children's texts, shortest first: each gets its length or an equal part of the rest."""
    kids = f.where("parent is not null").select(F.col("parent").alias("root"), F.col("fold").alias("child"), F.least(F.col("nbytes"), F.lit(budget)).alias("size"))
    by = W.partitionBy("root").orderBy("size", "child")
    r = kids.withColumn("n", F.count("*").over(W.partitionBy("root"))).withColumn("i", F.row_number().over(by) - 1)
    r = r.withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # while every shorter child fits, an equal part of what is left; from the first that does not, the same part for all
    part = F.floor((budget - F.col("before")) / (F.col("n") - F.col("i")))
    r = r.withColumn("part", part).withColumn("level", F.min(F.when(F.col("size") > F.col("part"), F.struct("i", "part"))).over(W.partitionBy("root")))
    return r.select("root", "child", F.when(F.col("level").isNull() | (F.col("i") < F.col("level.i")), F.col("size")).otherwise(F.col("level.part")).cast("bigint").alias("chars"))


def peek(m: DataFrame, budget: int, head_share: float = 0.6) -> DataFrame:
    """Head and tail of each row that is larger than the budget, on whole characters."""
    head = int(budget * head_share)
    r = m.where(F.col("nbytes") > budget).select("session", "idx", X.utf8_head(F.col("text"), head).alias("head"), X.utf8_tail(F.col("text"), budget - head).alias("tail"), "nbytes")
    return r.select("session", "idx", "head", "tail", (F.col("nbytes") - F.octet_length("head") - F.octet_length("tail")).alias("omitted"))
