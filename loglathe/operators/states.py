"""State logs and successive projections: replay, differences, chains, leases, divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from .ledgers import BY, share

#: Operations of the state log, by kind of event.
OPERATIONS = {"signup": "add", "purchase": "remove", "click": "brief", "view": "expand", "error": "unpin"}


def operations(e: DataFrame) -> DataFrame:
    """session, revision, op, id, value, base: one operation for each event, each on the revision before."""
    op = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in OPERATIONS.items()))
    base = F.lag("ordinal").over(BY())
    return e.select("session", F.col("ordinal").alias("revision"), op.alias("op"), F.col("k").alias("id"), F.round("value", 2).alias("value"), F.coalesce(base, F.lit(0)).alias("base"))


def replay(o: DataFrame, upto=None) -> DataFrame:
    """The folds that a log leaves: the last add or remove of each counts."""
    r = o.where("op in ('add', 'remove')")
    if upto is not None:
        r = r.join(upto, "session").where("revision <= upto")
    return r.groupBy("session", "id").agg(F.max_by("op", "revision").alias("op"), F.max("revision").alias("revision")).where("op = 'add'").select("session", "id", "revision")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Adds and removes between two states."""
    a, b = before.select("session", "id", F.lit(1).alias("old")), after.select("session", "id", F.lit(1).alias("new"))
    r = a.join(b, ["session", "id"], "full").where("old is null or new is null")
    return r.select("session", "id", F.when(F.col("old").isNull(), "add").otherwise("remove").alias("change"))


def middle(o: DataFrame) -> DataFrame:
    return o.groupBy("session").agg(F.floor(F.max("revision") / 2).alias("upto"))


def audit(o: DataFrame) -> DataFrame:
    """Deltas whose base is not the revision before them."""
    by = W.partitionBy("session").orderBy("revision")
    r = o.withColumn("expected", F.coalesce(F.lag("revision").over(by), F.lit(0)))
    return r.groupBy("session").agg(F.count("*").alias("deltas"), F.count_if(F.col("base") != F.col("expected")).alias("broken"), F.min(F.when(F.col("base") != F.col("expected"), F.col("revision"))).alias("first_broken"))


def brief_overrides(o: DataFrame) -> DataFrame:
    """Each fold's brief: the last that was set, else the one it was added with."""
    r = o.where("op in ('add', 'brief')").groupBy("session", "id").agg(F.max_by("value", F.when(F.col("op") == "brief", F.col("revision"))).alias("override"), F.max_by("value", F.when(F.col("op") == "add", F.col("revision"))).alias("stored"), F.count_if(F.col("op") == "add").alias("adds"))
    return r.where("adds > 0").select("session", "id", F.coalesce("override", "stored").alias("brief"), F.col("override").isNotNull().alias("overridden"))


def leases(o: DataFrame, generations: int = 8) -> DataFrame:
    """Leases by the last expansion, and what is left of them at the log's end (0: expired)."""
    end = o.groupBy("session").agg(F.max("revision").alias("last"))
    r = o.where("op = 'expand'").groupBy("session", "id").agg(F.max("revision").alias("granted")).join(end, "session")
    return r.select("session", "id", "granted", F.greatest(generations - (F.col("last") - F.col("granted")), F.lit(0)).alias("left"))


def topology(o: DataFrame) -> DataFrame:
    """A digest of each session's final folds."""
    r = replay(o).groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("folds"))
    return r.select("session", "folds", F.sha2("ids", 256).alias("sha"))


# -------------------------------------------------------------- projections
def successive(e: DataFrame) -> DataFrame:
    """Projections after each event, which show all events since the last commit: rows of the one before and of this one, and how many first rows they share.

    Within an island each projection is the one before and a row more; where a
    new one begins, only its single row can be the first of the last island's.
    """
    island = F.count_if(F.col("kind") == "purchase").over(BY())
    own = W.partitionBy("session", "island").orderBy("ordinal")
    r = e.withColumn("island", island).withColumn("n", F.row_number().over(own).cast("bigint")).withColumn("head", F.first("k").over(own))
    r = r.withColumn("before", F.lag("n").over(BY())).withColumn("old", F.lag("head").over(BY())).where("before is not null")
    common = F.when(F.col("n") > 1, F.col("before")).when(F.col("k").eqNullSafe(F.col("old")), 1).otherwise(0).cast("bigint")
    return r.select("session", "ordinal", "kind", common.alias("common"), "before", F.col("n").alias("after"))


def changes(p: DataFrame) -> DataFrame:
    """identical, append or rewrite, and the first index that differs."""
    kind = F.when((F.col("common") == F.col("before")) & (F.col("common") == F.col("after")), "identical").when(F.col("common") == F.col("before"), "append").otherwise("rewrite")
    return p.select("session", "ordinal", kind.alias("change"), "common", "before", "after")


def change_rollup(p: DataFrame) -> DataFrame:
    return changes(p).groupBy("change").agg(F.count("*").alias("n"), F.sum("common").alias("common"), share(F.sum("common"), F.sum("before")).alias("preserved_share"))


def char_divergence(m: DataFrame) -> DataFrame:
    """Where each row's text leaves the text of the row of the same role before."""
    by = W.partitionBy("session", "role").orderBy("idx")
    r = m.withColumn("before", F.lag("text").over(by)).where("before is not null")
    common = X.prefix_length(F.split("before", ""), F.split("text", ""))
    r = r.withColumn("common", common)
    return r.select("session", "idx", "common", share(F.col("common"), F.length("before")).alias("identical_share"))


def miss_classes(p: DataFrame) -> DataFrame:
    """Reads of the cache by how far they fell behind the prompt before."""
    prev = F.lag("prompt").over(BY())
    kept = F.try_divide(F.col("cache_read").cast("double"), F.col("prev").cast("double"))
    cls = F.when(F.col("prev").isNull(), "first").when((F.col("cache_read") == 0) & (F.col("cache_write") == 0), "unreported").when(F.col("cache_read") == 0, "miss").when(kept >= 0.99, "hit").otherwise("partial")
    return p.withColumn("prev", prev).withColumn("class", cls).groupBy("class").agg(F.count("*").alias("requests"), F.sum("cache_read").alias("read"), F.sum("prompt").alias("prompt"))
