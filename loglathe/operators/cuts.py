"""Briefs made by rule: ways to shorten what a fold holds, consolidations' briefs and sources, orientation.

Budgets count characters and are spent in order of preference.  Where a choice
goes on past what does not fit, candidates that cannot be chosen whatever comes
before are dropped by a window first, so that what is left to decide in turn has
a bound that depends on the budget alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from .forest import briefs_of
from .spans import held

#: Characters of a note, and of a subject at least.
NOTE, SUBJECT, SEPARATOR = 160, 24, " | "
#: Characters of sentences that can be chosen, and of lines of data at most.
SENTENCE, LINE = (20, 400), 300
TOKEN = "[a-z0-9_./-]{3,}"
DATA = r"\b(?=\w*\d)[\w./-]{4,}\b|\b\d{2,}\b"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# ------------------------------------------------------------- ways to cut
def cap_join(pieces: DataFrame, cap: int) -> DataFrame:
    """fold, brief: pieces (fold, place, text) in order, joined by line breaks as long as they fit; a first one that does not is cut."""
    by = W.partitionBy("fold").orderBy("place")
    p = pieces.withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    p = p.withColumn("upto", F.sum(F.length("text") + 1).over(by)).withColumn("n", F.row_number().over(by)).where((F.col("upto") <= cap) | (F.col("n") == 1))
    g = p.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"))
    return g.select("fold", F.left(F.array_join(F.transform("x", lambda v: v["text"]), "\n"), F.lit(cap)).alias("brief"))


def pieces(rows: DataFrame, parts: Column) -> DataFrame:
    """fold, place, text of the parts of each row, in order."""
    return rows.select("fold", "idx", F.posexplode(parts).alias("i", "text")).select("fold", F.struct("idx", "i").alias("place"), "text")


def last_assistant(rows: DataFrame, cap: int) -> DataFrame:
    r = rows.where("role = 'assistant'").withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    return r.groupBy("fold").agg(F.left(F.max_by("text", "idx"), F.lit(cap)).alias("brief"))


def assistant_notes(rows: DataFrame, cap: int) -> DataFrame:
    return cap_join(pieces(rows.where("role = 'assistant'"), F.array(F.left(trimmed(F.col("text")), F.lit(NOTE)))), cap)


def head_tail(rows: DataFrame, cap: int) -> DataFrame:
    """The first and the last paragraph of each row."""
    paragraphs = F.filter(F.transform(F.split("text", r"\n{2,}"), trimmed), lambda x: x != "")
    r = rows.withColumn("p", paragraphs)
    ends = F.when(F.size("p") > 1, F.array(F.element_at("p", 1), F.element_at("p", -1))).otherwise(F.col("p"))
    return cap_join(pieces(r, ends), cap)


def data_lines(rows: DataFrame, cap: int) -> DataFrame:
    """Lines with numbers or identifiers that hold digits."""
    lines = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: (x != "") & (F.length(x) <= LINE) & x.rlike(DATA))
    return cap_join(pieces(rows, lines), cap)


def sentences(rows: DataFrame) -> DataFrame:
    """fold, session, place, text, n: sentences of a length that can be chosen."""
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n+")
    s = rows.select("session", "fold", "idx", F.posexplode(cut).alias("i", "text")).withColumn("text", trimmed(F.col("text")))
    return s.withColumn("n", F.length("text")).where(F.col("n").between(*SENTENCE)).select("session", "fold", F.struct("idx", "i").alias("place"), "text", "n")


def salience(rows: DataFrame, every: DataFrame, cap: int) -> DataFrame:
    """Sentences of the rarest tokens first, as many as fit, what does not fit skipped; then in the order of the text.

    Rarity is over the rows ``every`` (session, text) of the session.  Of
    sentences of one length no more can be chosen than fit into the budget
    alone, and once one is skipped all later ones are: the first so many of each
    length are all that matters, a few thousand for a fold of any size.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    whole = every.groupBy("session").agg(F.count("*").alias("total"))
    df = every.select("session", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("session", "token").agg(F.count("*").alias("df"))
    s = sentences(rows)
    t = s.select("session", "fold", "place", "n", F.explode(tokens(F.col("text"))).alias("token")).join(df, ["session", "token"]).join(whole, "session")
    scored = t.groupBy("fold", "place", "n").agg(F.round(F.avg(F.log(F.col("total") / (1.0 + F.col("df")))), 6).alias("score"))
    of_length = W.partitionBy("fold", "n").orderBy(F.desc("score"), "place")
    few = scored.withColumn("r", F.row_number().over(of_length)).where(F.col("r") * (F.col("n") + 1) <= cap)
    ranked = few.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "place", "n"))).alias("x"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(few.select(F.array("place").alias("p")).schema["p"].dataType).alias("kept"))
    fits = lambda a, v: a["used"] + v["n"] + 1 <= cap
    step = lambda a, v: F.struct(F.when(fits(a, v), a["used"] + v["n"] + 1).otherwise(a["used"]).alias("used"), F.when(fits(a, v), F.array_append(a["kept"], v["place"])).otherwise(a["kept"]).alias("kept"))
    chosen = ranked.select("fold", F.explode(F.aggregate("x", start, step)["kept"]).alias("place"))
    g = chosen.join(s.select("fold", "place", "text"), ["fold", "place"]).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"))
    return g.select("fold", F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("brief"))


def all_cuts(m: DataFrame, folds: DataFrame, cap: int) -> DataFrame:
    """fold, way, brief: each disjoint fold's rows shortened in five ways; empty where a way finds nothing."""
    rows = held(m.select("session", "idx", "role", "text"), folds, "fold")
    ways = {"assistant notes": assistant_notes(rows, cap), "data lines": data_lines(rows, cap), "head and tail": head_tail(rows, cap), "last assistant": last_assistant(rows, cap), "salience": salience(rows, m, cap)}
    out = folds.select("fold", F.explode(F.array(*map(F.lit, ways))).alias("way"), F.lit("").alias("brief"))
    for way, df in ways.items():
        out = out.unionByName(df.select("fold", F.lit(way).alias("way"), "brief"))
    return out.groupBy("fold", "way").agg(F.max("brief").alias("brief"))


def survival(cuts: DataFrame, facts: DataFrame) -> DataFrame:
    """For each way: folds, how many of their facts (fold, fact) the brief carries, and its mean length."""
    j = cuts.join(facts, "fold")
    return j.groupBy("way").agg(F.count("*").alias("facts"), F.count_if(F.col("brief").contains(F.col("fact"))).alias("carried"), F.sum(F.length("brief")).alias("chars"))


# ----------------------------------------------------------- consolidations
def note(text: Column) -> Column:
    """A message's first paragraph in one line: from its first line that is not blank to before the next blank one."""
    first = F.regexp_extract(text, r"^\s*(\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*)", 1)
    return X.one_line(first)


def consolidation_brief(m: DataFrame, f: DataFrame, cap: int = 2000) -> DataFrame:
    """root, brief: children's briefs, then what the assistant noted in their span, within ``cap`` characters.

    The shortest subjects are served first, each with an equal part of what is
    left: one that fits leaves the rest to longer ones.  Subjects beyond those
    that can have SUBJECT characters each are only counted, so at most
    cap / (SUBJECT + 3) are shared among.
    """
    roots = f.where("kind = 'all'").select("session", F.col("fold").alias("root"), "start", "end")
    kids = f.where("parent is not null").select("session", F.col("parent").alias("root"), "fold", "start").join(roots.select("session", "root"), ["session", "root"])
    told = kids.join(briefs_of(m, f), ["session", "fold"]).select("root", F.lit(0).alias("side"), F.col("start").cast("bigint").alias("place"), X.one_line(F.col("brief")).alias("text"))
    noted = held(m.where("role = 'assistant'").select("session", "idx", "text"), roots, "root").withColumn("text", note(F.col("text"))).where("text <> ''")
    noted = noted.select("root", F.lit(1).alias("side"), F.col("idx").cast("bigint").alias("place"), X.bounded_subject(F.col("text"), NOTE).alias("text"))
    every = W.partitionBy("root")
    s = told.unionByName(noted).withColumn("folds", F.count_if(F.col("side") == 0).over(every)).withColumn("notes", F.count_if(F.col("side") == 1).over(every))
    s = s.withColumn("i", F.row_number().over(every.orderBy("side", "place")))
    total = F.col("folds") + F.col("notes")
    counted = F.when(F.col("notes") > 0, F.concat(F.col("folds").cast("string"), F.lit(" folds and "), F.col("notes").cast("string"), F.lit(" agent notes: "))).otherwise(F.concat(total.cast("string"), F.lit(" folds: ")))
    lead = F.concat(F.lit("Grouped completed context covering "), counted)
    s = s.withColumn("lead", lead).withColumn("room", cap - F.length("lead") - 1)
    gap = len(SEPARATOR)
    s = s.withColumn("named", F.greatest(F.lit(1), F.least(total, F.floor((F.col("room") + gap) / (SUBJECT + gap)))))
    omitted = total - F.col("named")
    tail = F.when(omitted > 0, F.concat(F.lit(SEPARATOR), omitted.cast("string"), F.when(F.col("notes") > 0, " more in this group").otherwise(" more folds in this group"))).otherwise("")
    s = s.withColumn("tail", tail).where("i <= named")
    budget = (F.col("room") - F.length("tail") - gap * (F.col("named") - 1)).cast("int")
    g = s.groupBy("root", "lead", "tail", budget.alias("budget")).agg(F.array_sort(F.collect_list(F.struct(F.length("text").alias("n"), "i", "text"))).alias("x"))
    size = F.size("x")
    start = F.struct(F.col("budget").alias("left"), F.lit(0).alias("taken"), F.array().cast("array<struct<i:int,text:string>>").alias("kept"))

    def step(a, v):
        owed = F.greatest(F.lit(1), F.floor(a["left"] / (size - a["taken"])).cast("int"))
        cut = F.when(F.length(v["text"]) <= owed, v["text"]).otherwise(F.concat(F.rtrim(F.left(v["text"], F.greatest(F.lit(0), owed - 3))), F.lit("...")))
        return F.struct((a["left"] - F.length(cut)).alias("left"), (a["taken"] + 1).alias("taken"), F.array_append(a["kept"], F.struct(v["i"].alias("i"), cut.alias("text"))).alias("kept"))

    parts = F.transform(F.array_sort(F.aggregate("x", start, step)["kept"]), lambda v: v["text"])
    return g.select("root", X.one_line(F.concat("lead", F.array_join(parts, SEPARATOR), "tail", F.lit("."))).alias("brief"))


COLLAPSED = "brief only: this child did not fit expanded"


def consolidation_source(m: DataFrame, f: DataFrame, most: int = 200_000) -> DataFrame:
    """root, collapsed, bytes, text: the children as one JSON list, the largest by their briefs only until ``most`` bytes hold it.

    A child's collapse saves a fixed number of bytes, so running sums over the
    children, the largest first, tell how many have to go.
    """
    roots = f.where("kind = 'all'").select("session", F.col("fold").alias("root"))
    kids = f.where("parent is not null").select("session", F.col("parent").alias("root"), "fold", "kind", "start", "end").join(roots, ["session", "root"])
    json = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{.x.:(.*)\}$", 1)
    rows = held(m.select("session", "idx", "role", "text"), kids, "fold").withColumn("json", F.concat(F.lit('{"role":'), json(F.col("role")), F.lit(',"text":'), json(F.col("text")), F.lit("}")))
    contents = rows.groupBy("fold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "json"))), lambda v: v["json"]), ",").alias("contents"))
    k = kids.join(briefs_of(m, f), ["session", "fold"]).join(contents, "fold", "left")
    by = W.partitionBy("root")
    k = k.withColumn("i", F.row_number().over(by.orderBy("start"))).withColumn("of", F.count("*").over(by))
    head = F.concat(F.lit('{"brief":'), json(F.col("brief")), F.lit(',"child":'), F.col("i").cast("string"), F.lit(","))
    last = F.concat(F.lit(',"foldId":'), json(F.col("fold")), F.lit(',"kind":'), json(F.col("kind")), F.lit(',"of":'), F.col("of").cast("string"), F.lit("}"))
    k = k.withColumn("full", F.concat(head, F.lit('"contents":['), F.coalesce("contents", F.lit("")), F.lit("]"), last)).withColumn("short", F.concat(head, F.lit(f'"collapsed":"{COLLAPSED}"'), last))
    size = lambda c: F.octet_length(c).cast("bigint")
    k = k.withColumn("whole", F.sum(size("full") + 1).over(by) + 1)
    order = by.orderBy(F.desc(size(F.coalesce("contents", F.lit("")))), "i")
    before = F.coalesce(F.sum(size("full") - size("short")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    k = k.withColumn("gone", F.col("whole") - before > most)  # too large with all larger ones collapsed
    k = k.withColumn("gone", F.min("gone").over(order))  # a child that does not have to go ends it
    g = k.groupBy("root").agg(F.count_if("gone").alias("collapsed"), F.array_sort(F.collect_list(F.struct("i", F.when(F.col("gone"), F.col("short")).otherwise(F.col("full")).alias("t")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["t"]), ","), F.lit("]"))
    return g.select("root", "collapsed", size(text).alias("bytes"), text.alias("text"))


# -------------------------------------------------------------- orientation
def orientation(m: DataFrame, f: DataFrame, messages: int = 2, chars: int = 12_000) -> DataFrame:
    """fold, side, rows, text: up to so many rows before and after each fold, as a JSON list of at most ``chars`` characters.

    Rows are taken from the fold outwards and end with the first that does not
    fit; the list is in the session's order.
    """
    json = F.to_json(F.struct("idx", "role", "text"))
    near = f.select("session", "fold", "start", "end", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side"), F.lit(messages).alias("k")).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("k"))))
    near = near.withColumn("idx", F.when(F.col("side") == "before", F.col("start") - F.col("step")).otherwise(F.col("end") - 1 + F.col("step")).cast("int"))
    r = near.join(m.select("session", F.col("idx").cast("int").alias("idx"), json.alias("json")), ["session", "idx"])
    by = W.partitionBy("fold", "side").orderBy("step")
    r = r.withColumn("upto", F.sum(F.length("json") + 1).over(by) + 1).where(F.col("upto") <= chars)
    taken = r.groupBy("fold", "side").agg(F.array_sort(F.collect_list(F.struct("idx", "json"))).alias("x"))
    both = f.select("fold", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side")).join(taken, ["fold", "side"], "left")
    rows = F.coalesce(F.array_join(F.transform("x", lambda v: v["idx"].cast("string")), ","), F.lit(""))
    text = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("x", lambda v: v["json"]), ","), F.lit("")), F.lit("]"))
    return both.select("fold", "side", rows.alias("rows"), text.alias("text"))
