"""Session trees as preorder intervals.

Logs are long chains with a few forks.  Rows that directly follow a parent
without other children form a segment, found by one window; the walk around the
tree of segments is a linked list, which pointer doubling ranks in as many
joins as the logarithm of its length, each with a row for every element.  Every
entry then has its place in preorder, the size of what descends from it, and its
depth: descendants and ancestors are range tests, and no closure is made.

Columns session, entry, parent and idx are read; a parent counts if it is an
earlier row of the session, otherwise the entry is a root.  A session without
rows has no intervals.  Entries of a session differ, as do their idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import discard, stored


def segments(e: DataFrame) -> DataFrame:
    """session, entry, idx, link (the parent that counts), seg and pos: chains without forks, numbered in each session."""
    base = e.select("session", "entry", "parent", "idx")
    kids = base.where("parent is not null").groupBy("session", F.col("parent").alias("entry")).agg(F.count("*").alias("kids"))
    above = base.join(kids, ["session", "entry"]).select("session", F.col("entry").alias("parent"), F.col("idx").alias("above"), "kids")
    by = W.partitionBy("session").orderBy("idx")
    r = base.join(above, ["session", "parent"], "left").withColumn("link", F.when(F.col("above") < F.col("idx"), F.col("parent")))
    head = F.col("link").isNull() | (F.col("kids") > 1) | ~F.lag("entry").over(by).eqNullSafe(F.col("link"))
    r = r.withColumn("head", head).withColumn("seg", F.count_if("head").over(by))
    r = r.withColumn("n", F.row_number().over(by)).withColumn("first", F.max(F.when(F.col("head"), F.col("n"))).over(by))
    return r.select("session", "entry", "idx", "link", "seg", (F.col("n") - F.col("first")).cast("bigint").alias("pos"))


def skeleton(s: DataFrame) -> DataFrame:
    """session, seg, above (the segment that holds its head's parent), length."""
    g = s.groupBy("session", "seg").agg(F.count("*").alias("length"), F.min_by("link", "pos").alias("link"), F.max_by("entry", "pos").alias("tail"))
    over = g.select("session", F.col("tail").alias("link"), F.col("seg").alias("above"))  # forks leave from tails only
    return g.join(over, ["session", "link"], "left").select("session", "seg", "above", "length")


def ranked(tree: DataFrame) -> tuple[DataFrame, int]:
    """session, seg, start, total, depth, segs and the number of rounds: preorder, entries below, depth of the head, segments below."""
    own = W.partitionBy("session", "above").orderBy("seg")
    child = tree.where("above is not null").groupBy("session", F.col("above").alias("seg")).agg(F.min("seg").alias("child"))
    t = tree.withColumn("sibling", F.lead("seg").over(own)).join(child, ["session", "seg"], "left")
    down = F.struct((F.col("seg") * 2).alias("key"), F.coalesce(F.col("child") * 2, F.col("seg") * 2 + 1).alias("next"), F.col("length").alias("w"), F.col("length").alias("d"), F.lit(1).cast("bigint").alias("c"))
    up = F.struct((F.col("seg") * 2 + 1).alias("key"), F.coalesce(F.col("sibling") * 2, F.col("above") * 2 + 1).alias("next"), F.lit(0).cast("bigint").alias("w"), (-F.col("length")).alias("d"), F.lit(0).cast("bigint").alias("c"))
    walk = stored(t.select("session", F.explode(F.array(down, up)).alias("x")).select("session", "x.*"), "walk")
    rounds = 0
    while not walk.where("next is not null").isEmpty():
        on = walk.select("session", F.col("key").alias("next"), F.col("next").alias("further"), *(F.col(c).alias(f"{c}2") for c in "wdc"))
        sums = [(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in "wdc"]
        farther = stored(walk.join(on, ["session", "next"], "left").select("session", "key", F.col("further").alias("next"), *sums), "walk")
        discard(walk)
        walk, rounds = farther, rounds + 1
    side = lambda which, *cols: walk.where(F.col("key") % 2 == which).select("session", F.floor(F.col("key") / 2).alias("seg"), *cols)
    both = side(0, F.col("w").alias("from"), (-F.col("d")).alias("depth"), F.col("c").alias("c0")).join(side(1, F.col("w").alias("rest"), F.col("c").alias("c1")), ["session", "seg"])
    whole = F.max("from").over(W.partitionBy("session"))
    return both.select("session", "seg", (whole - F.col("from")).alias("start"), (F.col("from") - F.col("rest")).alias("total"), "depth", (F.col("c0") - F.col("c1")).alias("segs")), rounds


def intervals(e: DataFrame) -> DataFrame:
    """session, entry, idx, pre, size, depth: what descends from an entry has pre in [pre, pre + size)."""
    s = stored(segments(e), "segments")
    r, _ = ranked(skeleton(s))
    return _placed(s, r)


def _placed(s: DataFrame, r: DataFrame) -> DataFrame:
    j = s.join(r, ["session", "seg"])
    return j.select("session", "entry", "idx", (F.col("start") + F.col("pos")).alias("pre"), (F.col("total") - F.col("pos")).alias("size"), (F.col("depth") + F.col("pos")).alias("depth"), "seg")


def on_branch(i: DataFrame) -> DataFrame:
    """session, leaf, entry, idx, distance: the root path of each session's last entry."""
    last = i.groupBy("session").agg(F.max_by(F.struct(F.col("entry").alias("leaf"), F.col("pre").alias("at"), F.col("depth").alias("low")), "idx").alias("x")).select("session", "x.*")
    inside = (F.col("pre") <= F.col("at")) & (F.col("at") < F.col("pre") + F.col("size"))
    return i.join(last, "session").where(inside).select("session", "leaf", "entry", "idx", (F.col("low") - F.col("depth")).alias("distance"))


def descendants(e: DataFrame) -> DataFrame:
    """entry, descendants, height: how many entries descend from each, and how far the deepest is."""
    s = stored(segments(e), "segments")
    r, rounds = ranked(skeleton(s))
    size = s.groupBy("session", "seg").agg(F.count("*").alias("length"))
    by = W.partitionBy("session").orderBy("start")
    t = r.join(size, ["session", "seg"]).withColumn("t0", F.col("depth") + F.col("length") - 1).withColumn("p", F.row_number().over(by))
    # the deepest of the 1, 2, 4 ... segments from each on; any range is two of them
    for k in range(rounds):
        t = t.withColumn(f"t{k + 1}", F.greatest(f"t{k}", F.coalesce(F.lead(f"t{k}", 1 << k).over(by), f"t{k}")))
    t = stored(t.select("session", "seg", "segs", "p", F.array(*(f"t{k}" for k in range(rounds + 1))).alias("deepest")), "deepest")
    k = F.floor(F.log2(F.col("segs").cast("double"))).cast("int")
    own = t.select("session", "seg", k.alias("k"), (F.col("p") + F.col("segs") - F.expr("cast(power(2, floor(log2(segs))) as int)")).cast("int").alias("p"), F.element_at("deepest", k + 1).alias("a"))
    other = t.select("session", "p", F.col("deepest").alias("others"))
    low = own.join(other, ["session", "p"]).select("session", "seg", F.greatest("a", F.element_at("others", F.col("k") + 1)).alias("low"))
    return _placed(s, r).join(low, ["session", "seg"]).select("entry", (F.col("size") - 1).alias("descendants"), (F.col("low") - F.col("depth")).alias("height"))


def nearest_above(e: DataFrame, marked: Column, value: str = "entry") -> DataFrame:
    """session, entry, found: ``value`` of the nearest proper ancestor that is marked, or null.

    Within a segment it is the last marked row before; beyond its head the
    answer is that of the segment above, found by doubling over segments.
    """
    own = e.select("session", "entry", "parent", "idx", F.when(marked, F.col(value)).alias("mark"))
    s = stored(segments(own).join(own.select("session", "entry", "mark"), ["session", "entry"]), "segments")
    last = s.groupBy("session", "seg").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos"))).alias("found"))
    t = stored(skeleton(s).join(last, ["session", "seg"]).select("session", "seg", "above", "found"), "marks")
    while not t.where("found is null and above is not null").isEmpty():
        up = t.select("session", F.col("seg").alias("above"), F.col("above").alias("higher"), F.col("found").alias("known"))
        j = t.join(up, ["session", "above"], "left")
        farther = stored(j.select("session", "seg", F.when(F.col("found").isNull() & F.col("known").isNull(), F.col("higher")).alias("above"), F.coalesce("found", "known").alias("found")), "marks")
        discard(t)
        t = farther
    over = skeleton(s).select("session", "seg", "above").join(t.select("session", F.col("seg").alias("above"), F.col("found").alias("beyond")), ["session", "above"], "left")
    before = F.last("mark", True).over(W.partitionBy("session", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return s.withColumn("before", before).join(over.select("session", "seg", "beyond"), ["session", "seg"]).select("session", "entry", F.coalesce("before", "beyond").alias("found"))
