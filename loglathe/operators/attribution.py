"""Where facts can be read on a session's branch: raw, in a brief, by recovery, on a dead branch, or nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import contained
from .spans import covering

#: Classes, the best first.
CLASSES = ["visible-raw", "visible-brief", "recoverable", "absent-off-branch", "absent"]


def view(branch: DataFrame, all_rows: DataFrame, folds: DataFrame, visible: DataFrame, briefs: DataFrame) -> DataFrame:
    """session, name, place, text: every text that can carry a fact, and how it is carried.

    Rows on the branch are raw, or behind the visible fold that covers them;
    briefs are visible with their fold; rows off the branch are apart.
    """
    rows = covering(branch.select("session", "entry", "idx", "text"), visible, "fold")
    raw = rows.select("session", F.col("entry").cast("string").alias("name"), F.when(F.col("fold").isNull(), "visible_raw").otherwise("recoverable_source").alias("place"), "text")
    shown = visible.select("session", "fold", F.lit(True).alias("shown"))
    b = folds.select("session", "fold").join(briefs.select("session", "fold", "brief"), ["session", "fold"]).join(shown, ["session", "fold"], "left")
    told = b.select("session", F.col("fold").alias("name"), F.when(F.col("shown"), "visible_brief").otherwise("recoverable_brief").alias("place"), F.col("brief").alias("text"))
    off = all_rows.join(branch.select("session", "entry"), ["session", "entry"], "left_anti").select("session", F.col("entry").cast("string").alias("name"), F.lit("off_branch").alias("place"), "text")
    return raw.unionByName(told).unionByName(off)


def attributed(v: DataFrame, facts: DataFrame) -> DataFrame:
    """session, fact, class and the names of what carries it by place, sorted and joined by commas.

    ``off_branch`` is given only where nothing on the branch carries the fact.
    """
    known = facts.select("session", F.col("fact").cast("string").alias("fact"), "value")
    hits = contained(v.select("session", F.concat("place", F.lit("/"), "name").alias("item"), "text"), known)
    hits = hits.select("session", "fact", F.substring_index("item", "/", 1).alias("place"), F.expr("substring(item, instr(item, '/') + 1)").alias("name"))
    places = ["visible_raw", "visible_brief", "recoverable_source", "recoverable_brief", "off_branch"]
    names = lambda p: F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") == p, F.col("name")))), ",").alias(p)
    none = known.select("session", "fact", F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("name"))
    g = hits.unionByName(none).groupBy("session", "fact").agg(*(names(p) for p in places))
    has = lambda p: F.col(p) != ""
    cls = F.when(has("visible_raw"), CLASSES[0]).when(has("visible_brief"), CLASSES[1]).when(has("recoverable_source") | has("recoverable_brief"), CLASSES[2]).when(has("off_branch"), CLASSES[3]).otherwise(CLASSES[4])
    r = g.withColumn("class", cls)
    return r.withColumn("off_branch", F.when(F.col("class") == CLASSES[3], F.col("off_branch")).otherwise(""))


def variants(probes: DataFrame) -> DataFrame:
    """session, probe, kind, fact, value over columns session, probe, value and trace (what the value is bound to, or null).

    A value of one or two digits says nothing alone, only bound to its trace; a
    single digit is written with a leading zero as well.
    """
    digits = F.col("value").rlike("^[0-9]{1,2}$")
    padded = F.when(F.col("value").rlike("^[0-9]$"), F.array(F.col("value"), F.concat(F.lit("0"), "value"))).otherwise(F.array("value"))
    bare = F.when(digits, F.array().cast("array<string>")).otherwise(padded)
    bound = F.when(F.col("trace").isNull(), F.array().cast("array<string>")).otherwise(F.transform(padded, lambda x: F.concat(F.col("trace"), F.lit(": "), x)))
    of = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    r = probes.select("session", "probe", F.posexplode(F.concat(of("value", bare), of("binding", bound))).alias("i", "x"))
    return r.select("session", "probe", "x.kind", F.concat_ws("/", "probe", "x.kind", "i").alias("fact"), "x.value")


def best_carriage(v: DataFrame, probes: DataFrame) -> DataFrame:
    """session, probe, value_class, binding_class: the best class among a probe's variants, null where it has none."""
    known = variants(probes)
    found = known.join(attributed(v, known).select("session", "fact", "class"), ["session", "fact"])
    rank = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("class"))
    best = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("class")), F.when(F.col("kind") == kind, rank)).alias(f"{kind}_class")
    return probes.select("session", "probe").join(found.groupBy("session", "probe").agg(best("value"), best("binding")), ["session", "probe"], "left")


def rollup(b: DataFrame) -> DataFrame:
    return b.groupBy("value_class", "binding_class").agg(F.count("*").alias("probes"))
