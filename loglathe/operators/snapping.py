"""Spans moved to boundaries that folds and units have, with a log of why.

A position of a session is looked up in an index of its own: the root fold and
the closed unit that hold it, the next unit, the last one that has ended, and
where so many turns from there end.  Windows over the rows make the index; each
pass of the fix point joins spans to it by position, so that nothing is compared
with a whole session.

Tables: rows (session, pos), roots (session, fold, start, end inclusive, tool),
units (session, start, end exclusive, turn), boundaries (session, boundary: the
last row before the turn in flight), spans (session, span, start, end inclusive).
Roots of a session are disjoint, and so are its units, whose turns are numbered
without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import stored
from .spans import covering

MODES = ("nearest", "exclude", "absorb")
MAX_IDS = 64


def index(rows: DataFrame, roots: DataFrame, units: DataFrame, max_turns: int) -> DataFrame:
    """session, pos, fold, rs, re, us, ue, f (end of the first unit from here on), cap (end of its turn and the next ones), done (end of the last unit before)."""
    turns = units.groupBy("session", "turn").agg(F.max("end").alias("upto"))
    turns = turns.withColumn("cap", F.lead("upto", max_turns - 1).over(W.partitionBy("session").orderBy("turn")))
    u = units.join(turns.select("session", "turn", "cap"), ["session", "turn"]).withColumn("us", F.col("start")).withColumn("ue", F.col("end"))
    r = covering(rows.withColumnRenamed("pos", "idx"), roots.select("session", "fold", "start", F.col("end").alias("re"), (F.col("end") + 1).alias("end"), F.col("start").alias("rs")), "fold", "rs", "re")
    r = covering(r, u, "us", "ue", "cap")
    # from the last row back, so that a row adds to what the ones after it hold: frames that end with the session would be read again for each row
    by = lambda order: W.partitionBy("session").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.last(F.when(F.col("us") == F.col("idx"), F.struct("ue", "cap")), True).over(by(F.desc("idx")))
    done = F.last(F.when(F.col("ue") == F.col("idx") + 1, F.col("ue")), True).over(by("idx"))
    r = r.withColumn("first", first).withColumn("done", done)
    inside = F.col("us").isNotNull()
    return r.select("session", F.col("idx").alias("pos"), "fold", "rs", "re", "us", "ue", F.when(inside, F.col("ue")).otherwise(F.col("first.ue")).alias("f"), F.when(inside, F.col("cap")).otherwise(F.col("first.cap")).alias("cap"), "done")


def _noted(log, changed, *reason):
    """The log with a line more: why, and what the span is now."""
    line = F.concat(*reason, F.lit("@"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    return F.when(changed, F.concat(log, F.lit("; "), line)).otherwise(log)


def _pass(spans: DataFrame, places: DataFrame, first: bool) -> DataFrame:
    at = lambda end, *columns: places.select("session", F.col("pos").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    t = spans.withColumn("s0", F.col("s")).withColumn("e0", F.col("e"))
    t = t.join(at("s", "fold", "rs", "re"), ["session", "s"], "left").join(at("e", "fold", "rs", "re"), ["session", "e"], "left")

    def absorbed(nearer):
        return (F.col("mode") == "absorb") | ((F.col("mode") == "nearest") & nearer) if first else F.lit(True)

    cut = F.coalesce((F.col("s") > F.col("s_rs")) & (F.col("s") <= F.col("s_re")), F.lit(False))
    into = absorbed(F.col("s") - F.col("s_rs") <= F.col("s_re") + 1 - F.col("s"))
    t = t.withColumn("cut", cut).withColumn("into", into).withColumn("s", F.when(cut, F.when(into, F.col("s_rs")).otherwise(F.col("s_re") + 1)).otherwise(F.col("s")))
    t = t.withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("started inside "), F.col("s_fold"), F.when(F.col("into"), ", to its start").otherwise(", to its far boundary")))
    cut = F.coalesce((F.col("e") >= F.col("e_rs")) & (F.col("e") < F.col("e_re")), F.lit(False))
    into = absorbed(F.col("e_re") - F.col("e") <= F.col("e") - (F.col("e_rs") - 1))
    t = t.withColumn("cut", cut).withColumn("into", into).withColumn("e", F.when(cut, F.when(into, F.col("e_re")).otherwise(F.col("e_rs") - 1)).otherwise(F.col("e")))
    t = t.withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("ended inside "), F.col("e_fold"), F.when(F.col("into"), ", to its end").otherwise(", to its near boundary")))
    flight = F.coalesce(F.col("e") > F.col("boundary"), F.lit(False))
    t = t.withColumn("cut", flight).withColumn("e", F.when(flight, F.col("boundary")).otherwise(F.col("e")))
    t = t.withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("reached into the turn in flight")))
    t = t.select("session", "span", "mode", "boundary", "s", "e", "s0", "e0", "log").join(at("s", "us", "f", "cap"), ["session", "s"], "left").join(at("e", "ue", "done"), ["session", "e"], "left")
    mid = F.coalesce(F.col("s_us") != F.col("s"), F.lit(False))
    t = t.withColumn("cut", mid).withColumn("s", F.when(mid, F.col("s_us")).otherwise(F.col("s"))).withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("started mid-unit")))
    mid = F.coalesce(F.col("e_ue") - 1 != F.col("e"), F.lit(False))
    t = t.withColumn("cut", mid).withColumn("e", F.when(mid, F.col("e_ue") - 1).otherwise(F.col("e"))).withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("ended mid-unit")))
    # units within the span: up to the last that has ended, and to the last turn that fits
    clamped = F.least(F.coalesce("e_ue", "e_done"), F.col("s_cap")) - 1
    over = F.coalesce((F.col("s_f") <= F.col("e") + 1) & (clamped < F.col("e")), F.lit(False))
    t = t.withColumn("cut", over).withColumn("e", F.when(over, clamped).otherwise(F.col("e"))).withColumn("log", _noted(F.col("log"), F.col("cut"), F.lit("more turns than a chapter holds")))
    return t.select("session", "span", "mode", "boundary", "s", "e", "log", ((F.col("s") != F.col("s0")) | (F.col("e") != F.col("e0"))).alias("moved"))


def snapped(spans: DataFrame, places: DataFrame, boundaries: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """session, span, mode, start, end, log: readings that needed a correction and are not empty."""
    t = spans.join(boundaries, "session", "left").select("session", "span", F.explode(F.array(*(F.lit(m) for m in modes))).alias("mode"), "boundary", F.col("start").alias("s"), F.col("end").alias("e"), F.lit("").alias("log"), F.lit(True).alias("moved"))
    first, settled = True, None
    while True:
        t = stored(_pass(t.drop("moved"), places, first), "spans")
        rest = t.where(~F.col("moved"))
        settled = rest if settled is None else settled.unionByName(rest)
        first = False
        if t.where("moved").isEmpty():
            break
        t = t.where("moved")
    return settled.where("log <> '' and e >= s").select("session", "span", "mode", F.col("s").alias("start"), F.col("e").alias("end"), F.substring("log", 3, 1 << 30).alias("log"))


def outward(spans: DataFrame, places: DataFrame) -> DataFrame:
    """session, span, start, end, moved: spans grown to the whole boundaries of the folds that they cut."""
    at = lambda end: places.select("session", F.col("pos").alias(end), F.col("rs").alias(f"{end}_rs"), F.col("re").alias(f"{end}_re"))
    t = spans.select("session", "span", F.col("start").alias("s"), F.col("end").alias("e")).join(at("s"), ["session", "s"], "left").join(at("e"), ["session", "e"], "left")
    start, end = F.coalesce("s_rs", "s"), F.coalesce("e_re", "e")
    return t.select("session", "span", start.alias("start"), end.alias("end"), ((start != F.col("s")) | (end != F.col("e"))).alias("moved"))


def whole_folds(spans: DataFrame, places: DataFrame, roots: DataFrame) -> DataFrame:
    """session, span, start, end, folds: outward readings that two or more folds tile, none a tool's.

    Sums of prefixes over a session's roots tell how many lie between two of
    them, how many rows they have, and whether any is a tool's.
    """
    by = W.partitionBy("session").orderBy("start")
    size = F.col("end") - F.col("start") + 1
    r = roots.select("session", "start", "end", F.row_number().over(by).alias("n"), F.sum(size).over(by).alias("size"), size.alias("own"), F.count_if("tool").over(by).alias("tools"), F.col("tool").cast("bigint").alias("own_tool"))
    a = r.select("session", "start", F.col("n").alias("n0"), (F.col("size") - F.col("own")).alias("size0"), (F.col("tools") - F.col("own_tool")).alias("tools0"))
    b = r.select("session", "end", F.col("n").alias("n1"), F.col("size").alias("size1"), F.col("tools").alias("tools1"))
    t = outward(spans, places).where("moved").join(a, ["session", "start"]).join(b, ["session", "end"])
    tiles = (F.col("n1") > F.col("n0")) & (F.col("size1") - F.col("size0") == F.col("end") - F.col("start") + 1) & (F.col("tools1") == F.col("tools0"))
    return t.where(tiles).select("session", "span", "start", "end", (F.col("n1") - F.col("n0") + 1).cast("bigint").alias("folds"))


def aligned(spans: DataFrame, places: DataFrame, units: DataFrame, max_turns: int) -> DataFrame:
    """session, span, aligned: whether units tile the span exactly, of so many turns at most."""
    by = W.partitionBy("session").orderBy("start")
    size = F.col("end") - F.col("start")
    r = units.select("session", "start", "end", "turn", F.sum(size).over(by).alias("size"), size.alias("own"))
    a = r.select("session", "start", (F.col("size") - F.col("own")).alias("size0"), F.col("turn").alias("t0"))
    b = r.select("session", (F.col("end") - 1).alias("end"), F.col("size").alias("size1"), F.col("turn").alias("t1"))
    t = spans.select("session", "span", "start", "end").join(a, ["session", "start"], "left").join(b, ["session", "end"], "left")
    fits = (F.col("size1") - F.col("size0") == F.col("end") - F.col("start") + 1) & (F.col("t1") - F.col("t0") < max_turns)
    return t.select("session", "span", F.coalesce(fits, F.lit(False)).alias("aligned"))


def chosen(spans: DataFrame, places: DataFrame, boundaries: DataFrame, roots: DataFrame, units: DataFrame, max_turns: int) -> DataFrame:
    """session, span, reading, start, end, log: the span itself if units tile it, else the first distinct corrected reading that can be built.

    Readings are tried in the order nearest, exclude, absorb, whole folds; one
    that equals an earlier one is not tried again.
    """
    readings = snapped(spans, places, boundaries).withColumnRenamed("mode", "reading").unionByName(whole_folds(spans, places, roots).select("session", "span", F.lit("whole-folds").alias("reading"), "start", "end", F.concat(F.lit("tiled by "), F.col("folds").cast("string"), F.lit(" folds")).alias("log")))
    direct = spans.select("session", "span", F.lit("direct").alias("reading"), "start", "end", F.lit("").alias("log"))
    every = stored(direct.unionByName(readings), "readings")
    built = aligned(every.select("session", F.struct("span", "reading").alias("span"), "start", "end"), places, units, max_turns).select("session", "span.span", "span.reading", "aligned")
    rank = F.array_position(F.array(*(F.lit(x) for x in ("direct", *MODES, "whole-folds"))), F.col("reading"))
    can = every.join(built, ["session", "span", "reading"]).where(F.col("aligned") | (F.col("reading") == "whole-folds")).withColumn("rank", rank)
    best = can.groupBy("session", "span").agg(F.min_by(F.struct("reading", "start", "end", "log"), "rank").alias("x")).select("session", "span", "x.*")
    return best


def resolved(requests: DataFrame, rows: DataFrame, roots: DataFrame, nested: DataFrame) -> DataFrame:
    """session, span, start, end, refused over requests (session, span, ids): ids of rows and of folds made spans.

    A request holds 1 to 64 ids that are not empty; a nested fold, or an id that
    the session does not have, refuses it.  The span goes from the first start
    to the end of what starts last.
    """
    known = rows.select("session", F.col("id"), F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit(None).cast("string").alias("why"))
    known = known.unionByName(roots.select("session", F.col("fold").alias("id"), "start", "end", F.lit(None).cast("string").alias("why")))
    known = known.unionByName(nested.select("session", F.col("fold").alias("id"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit("nested").alias("why")))
    size = F.coalesce(F.size("ids"), F.lit(0))
    shape = (size < 1) | (size > MAX_IDS) | F.coalesce(F.exists("ids", lambda x: F.coalesce(x == "", F.lit(True))), F.lit(True))
    t = requests.select("session", "span", shape.alias("shape"), F.explode_outer("ids").alias("id")).join(known, ["session", "id"], "left")
    g = t.groupBy("session", "span").agg(F.max("shape").alias("shape"), F.max("why").alias("why"), F.count_if(F.col("start").isNull() & F.col("why").isNull()).alias("lost"), F.min("start").alias("start"), F.max_by("end", "start").alias("end"))
    refused = F.when(F.col("shape"), "shape").when(F.col("lost") > 0, "unknown").when(F.col("why").isNotNull(), F.col("why"))
    keep = lambda c: F.when(refused.isNull(), F.col(c)).alias(c)
    return g.select("session", "span", keep("start"), keep("end"), refused.alias("refused"))
