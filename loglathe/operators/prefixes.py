"""Common prefixes of lists by digests of prefixes and halving.

A prefix's digest is the sum of digests of its items with their places, taken
from 120 bits of SHA-256, so that one window gives all of a list's prefixes and
any two lists are compared in a logarithmic number of lookups, whatever their
lengths.  Columns session, list, pos (0, 1, 2 ...) and item (text) are read; a
null item equals a null item only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..storage import stored


def digests(items: DataFrame) -> DataFrame:
    """session, list, n, a, b: the digest of each list's first n items."""
    sha = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.when(F.col("item").isNull(), "-").otherwise("+"), F.coalesce("item", F.lit(""))), 256)
    part = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)")
    by = W.partitionBy("session", "list").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return items.select("session", "list", (F.col("pos") + 1).cast("bigint").alias("n"), F.sum(part(1)).over(by).alias("a"), F.sum(part(16)).over(by).alias("b"))


def common(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """session, left, right, left_items, right_items, common over pairs (session, left, right) of lists.

    A list without rows is empty.
    """
    d = stored(digests(items), "digests")
    size = d.groupBy("session", "list").agg(F.max("n").alias("n"))
    of = lambda side: size.select("session", F.col("list").alias(side), F.col("n").alias(f"{side}_items"))
    p = pairs.join(of("left"), ["session", "left"], "left").join(of("right"), ["session", "right"], "left").fillna(0, ["left_items", "right_items"])
    p = stored(p.withColumn("lo", F.lit(0).cast("bigint")).withColumn("hi", F.least("left_items", "right_items")), "pairs")
    at = lambda side: d.select("session", F.col("list").alias(side), F.col("n").alias("mid"), F.struct("a", "b").alias(f"{side}_digest"))
    done = None
    while True:
        settled = p.where("lo = hi")
        done = settled if done is None else done.unionByName(settled)
        rest = p.where("lo < hi")
        if rest.isEmpty():
            break
        asked = rest.withColumn("mid", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("bigint"))
        same = F.col("left_digest") == F.col("right_digest")
        j = asked.join(at("left"), ["session", "left", "mid"]).join(at("right"), ["session", "right", "mid"])
        p = stored(j.select("session", "left", "right", "left_items", "right_items", F.when(same, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi")).otherwise(F.col("mid") - 1).alias("hi")), "pairs")
    return done.select("session", "left", "right", "left_items", "right_items", F.col("lo").alias("common"))


#: The projections that a repetition has, and the relations that are read.
PROJECTIONS = ["raw", "folded", "expanded", "refolded", "warm", "carrier", "withdrawn"]
RELATIONS = {"raw_prefix_of_expanded": ("raw", "expanded"), "folded_prefix_of_refolded": ("folded", "refolded"), "warm_prefix_of_carrier": ("warm", "carrier"), "warm_prefix_of_withdrawn": ("warm", "withdrawn")}
FORK = ("carrier", "withdrawn")


def topology(items: DataFrame) -> DataFrame:
    """Relations among a session's seven projections, and whether all hold; null where a projection is missing.

    The carrier and what is left after its withdrawal may part only behind the
    warm prefix.
    """
    sessions = items.select("session").distinct()
    sides = [*RELATIONS.values(), FORK]
    pairs = sessions.select("session", F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in sides))).alias("x")).select("session", "x.*")
    c = common(items, pairs)
    is_pair = lambda a, b: (F.col("left") == a) & (F.col("right") == b)
    prefix = [F.max(F.when(is_pair(*p), F.col("common") == F.col("left_items"))).alias(name) for name, p in RELATIONS.items()]
    sizes = [F.max(F.when(F.col("left") == x, F.col("left_items")).when(F.col("right") == x, F.col("right_items"))).alias(f"{x}_items") for x in PROJECTIONS]
    g = c.groupBy("session").agg(*sizes, F.max(F.when(is_pair(*FORK), F.col("common"))).alias("carrier_withdrawn_common"), *prefix)
    g = g.withColumn("fork_after_warm", F.col("carrier_withdrawn_common") >= F.col("warm_items"))
    g = g.withColumn("complete", F.least(*(F.col(f"{x}_items") for x in PROJECTIONS)) > 0)
    holds = [*RELATIONS, "fork_after_warm"]
    known = [F.when(F.col("complete"), F.col(x)).alias(x) for x in [*(f"{x}_items" for x in PROJECTIONS), "carrier_withdrawn_common", *holds]]
    every = F.forall(F.array(*map(F.col, holds)), lambda x: x)
    return g.select("session", "complete", *known, (F.col("complete") & F.coalesce(every, F.lit(False))).alias("confirmed"))
