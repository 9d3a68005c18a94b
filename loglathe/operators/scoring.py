"""Decisions at thresholds, calibration, contrasts and other algebra over scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from .ledgers import share

LEAST_OFFERS = 4
#: Cases up to which the binomial tail reads logarithms of factorials from a table.
TABLED = 60


def at_thresholds(d: DataFrame) -> DataFrame:
    """Offers, hits and opportunities at each distinct confidence, from columns confidence, correct, opportunity, class.

    One sum over the distinct confidences, from the highest down.
    """
    per = d.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("good"), F.count_if(~F.col("correct") & (F.col("class") == 1)).alias("false_one"))
    down = W.orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, 0)  # distinct confidences only
    whole = d.agg(F.count_if("opportunity").alias("opportunities"))
    r = per.select(F.col("confidence").alias("threshold"), F.sum("n").over(down).alias("offers"), F.sum("good").over(down).alias("good"), F.sum("false_one").over(down).alias("false_one"))
    return r.crossJoin(F.broadcast(whole))  # one row


def sweep(d: DataFrame) -> DataFrame:
    r = at_thresholds(d)
    p, q = share(F.col("good"), F.col("offers")), share(F.col("good"), F.col("opportunities"))
    f1 = F.round(F.try_divide(2 * F.col("good").cast("double"), (F.col("offers") + F.col("opportunities")).cast("double")), 6)
    return r.select("threshold", "offers", "good", "false_one", p.alias("precision"), q.alias("recall"), f1.alias("f1"), F.round(X.wilson_lower(F.col("good"), F.col("offers")), 6).alias("wilson"))


def best_points(d: DataFrame) -> DataFrame:
    """The best F1, and the best recall at some precisions."""
    s = sweep(d)
    one = lambda name, c, key: s.where(c).agg(F.max(F.struct(F.col(key), F.col("threshold"))).alias("x")).select(F.lit(name).alias("point"), F.col(f"x.{key}").alias("value"), F.col("x.threshold").alias("threshold"))
    return one("f1", F.lit(True), "f1").unionByName(one("recall at 0.5", F.col("precision") >= 0.5, "recall")).unionByName(one("recall at 0.75", F.col("precision") >= 0.75, "recall")).unionByName(one("recall at 0.9", F.col("precision") >= 0.9, "recall"))


def calibrate(d: DataFrame, precision: float = 1.0) -> DataFrame:
    """The threshold with most offers, then the highest, of those with that precision and offers enough."""
    s = sweep(d).where((F.col("offers") >= LEAST_OFFERS) & (F.col("precision") >= precision))
    return s.agg(F.max(F.struct("offers", "threshold")).alias("x")).select(F.col("x.threshold").alias("threshold"), F.col("x.offers").alias("offers"))


def classes_at(d: DataFrame, threshold: float) -> DataFrame:
    """Offers, good and false ones of each class at a threshold."""
    o = F.col("confidence") >= threshold
    r = d.groupBy("class").agg(F.count("*").alias("cases"), F.count_if(o).alias("offers"), F.count_if(o & F.col("correct")).alias("good"), F.count_if(o & ~F.col("correct")).alias("false"), F.count_if("opportunity").alias("opportunities"))
    return r.select("*", share(F.col("good"), F.col("offers")).alias("precision"), share(F.col("good"), F.col("opportunities")).alias("recall"), F.round(X.wilson_lower(F.col("good"), F.col("offers")), 6).alias("wilson"))


def point_biserial(d: DataFrame) -> DataFrame:
    """Correlation of confidence and correctness in each class; null where all are alike."""
    y = F.col("correct").cast("double")
    varied = F.min("correct") != F.max("correct")
    x, n = F.col("confidence"), F.count("*")
    spread = lambda v: n * F.sum(v * v) - F.sum(v) * F.sum(v)
    r_ = F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), F.sqrt(spread(x) * spread(y)))
    r = d.groupBy("class").agg(F.count("*").alias("n"), F.when(varied, F.round(r_, 6)).alias("r"), F.round(F.avg(F.when(F.col("correct"), F.col("confidence"))), 6).alias("mean_correct"), F.round(F.avg(F.when(~F.col("correct"), F.col("confidence"))), 6).alias("mean_wrong"))
    return r


def binomial_tail(d: DataFrame, p: float) -> DataFrame:
    """P(at least as many correct as seen) for each class and confidence under chance p, for groups of any size.

    Terms come from logarithms of factorials up to TABLED cases, and from
    Loader's saddle-point form above, whose error does not grow with n.
    """
    g = d.groupBy("class", "confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("s"))
    n, x = F.col("n"), F.col("n").cast("double")
    logs = [math.lgamma(i + 1) for i in range(TABLED + 1)]
    table = F.array(*map(F.lit, logs))
    at = lambda i: F.get(table, i.cast("int"))
    small = lambda k: at(n) - at(k) - at(n - k) + k * math.log(p) + (n - k) * math.log(1 - p)
    rest = F.array(F.lit(0.0), *(F.lit(v - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)) for i, v in enumerate(logs) if i))
    beyond = lambda i: F.when(i <= TABLED, F.get(rest, i.cast("int"))).otherwise((1 / 12 - (1 / 360 - 1 / 1260 / (i * i)) / (i * i)) / i)  # noqa: E731  what Stirling's formula lacks
    away = lambda i, mean: i * F.log1p((i - mean) / mean) - (i - mean)

    def large(k):
        i, j = k.cast("double"), (n - k).cast("double")
        inner = beyond(x) - beyond(i) - beyond(j) - away(i, x * p) - away(j, x * (1 - p)) + 0.5 * F.log(x / (2 * math.pi * i * j))
        return F.when(k == 0, x * math.log1p(-p)).when(k == n, x * math.log(p)).otherwise(inner)

    term = lambda k: F.exp(F.when(n <= TABLED, small(k)).otherwise(large(k)))
    # terms further than 20 roots of n from the mean are below exp(-800), which is 0 as a double
    first, last = F.greatest(F.col("s"), F.floor(x * p - 20 * F.sqrt(x))), F.least(n, F.ceil(x * p + 20 * F.sqrt(x)))
    tail = F.when(first > last, F.lit(0.0)).otherwise(F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0.0), lambda acc, k: acc + term(k)))
    return g.select("class", "confidence", "n", "s", F.round(tail, 6).alias("tail"))


# ------------------------------------------------------------------ vectors
def centroids(e: DataFrame) -> DataFrame:
    """label, i, c: the mean of each component over a label's vectors."""
    x = e.select("label", F.posexplode("embedding").alias("i", "x"))
    # sums of whole numbers are the same in any order
    return x.groupBy("label", "i").agg((F.sum(F.round(F.col("x").cast("double") * 1e9).cast("bigint")) / F.count("*") / 1e9).alias("c"))


def millionths(x) -> Column:
    """The mean of values of six places, in whole millionths, halves upwards: by whole numbers, so that neither order nor ties matter."""
    n = F.count(x)
    t = 2 * F.sum(F.round(x * 1e6).cast("bigint")) + n
    return ((t - F.pmod(t, 2 * n)) / (2 * n)).cast("bigint")


def affinities(e: DataFrame) -> DataFrame:
    """vec_id, label, candidate, score: products of all vectors with all labels' centroids."""
    c = centroids(e).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("v")).select(F.col("label").alias("candidate"), F.transform("v", lambda x: x["c"]).alias("c"))
    # as many rows as labels, each one vector long; Spark looks at their size before it chooses how to join
    r = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).crossJoin(c)
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return r.select("vec_id", "label", "candidate", F.round(dot, 6).alias("score"))


def density_shares(a: DataFrame) -> DataFrame:
    """Ranks of candidates by score, ties by name, and each one's share of all positive scores."""
    positive = F.greatest(F.col("score"), F.lit(0.0))
    by = W.partitionBy("vec_id")
    r = a.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "candidate"))).withColumn("mass", positive)
    r = r.withColumn("share", F.round(F.try_divide(F.col("mass"), F.sum("mass").over(by)), 4)).where("rank = 1")
    return r.select("vec_id", "candidate", "score", "share")


def contrasts(a: DataFrame) -> DataFrame:
    """The candidate whose score rises most over its mean score, and by how much over the second."""
    neutral = a.groupBy("candidate").agg((millionths(F.col("score")) / 1e6).alias("neutral"))
    by = W.partitionBy("vec_id").orderBy(F.desc("lift"), "candidate")
    r = a.join(neutral, "candidate").withColumn("lift", F.round(F.col("score") - F.col("neutral"), 6))
    r = r.withColumn("rank", F.row_number().over(by)).withColumn("second", F.lead("lift").over(by)).where("rank = 1")
    return r.select("vec_id", "candidate", "lift", F.round(F.col("lift") - F.col("second"), 6).alias("margin"), (F.col("candidate") == F.col("label")).alias("right"))


def softmax_sources(a: DataFrame) -> DataFrame:
    """For each vector the probability of its own label among all, and the margin over the best other."""
    by = W.partitionBy("vec_id")
    r = a.withColumn("e", F.exp("score")).withColumn("total", F.sum("e").over(by))
    own = F.col("candidate") == F.col("label")
    g = r.groupBy("vec_id").agg(F.max(F.when(own, F.round(F.col("e") / F.col("total"), 5))).alias("p"), F.max(F.when(own, F.col("score"))).alias("own"), F.max(F.when(~own, F.col("score"))).alias("other"))
    return g.select("vec_id", "p", F.round(F.col("own") - F.col("other"), 6).alias("margin"), (F.col("own") > F.col("other")).alias("right"))


def counterbalanced(a: DataFrame) -> DataFrame:
    """Margins of each pair of label and vector read both ways: the least, the mean, and whether both are positive."""
    own = a.where("candidate = label").select("vec_id", F.col("score").alias("own"))
    r = a.where("candidate <> label").join(own, "vec_id")
    g = r.groupBy("label", "candidate").agg(millionths(F.col("own") - F.col("score")).alias("forward"))
    back = g.select(F.col("label").alias("candidate"), F.col("candidate").alias("label"), F.col("forward").alias("backward"))
    j = g.join(back, ["label", "candidate"]).where("label < candidate")
    return j.select("label", "candidate", (F.least("forward", "backward") / 1e6).alias("least"), ((F.col("forward") + F.col("backward")) / 2e6).alias("mean"), ((F.col("forward") > 0) & (F.col("backward") > 0)).alias("both"))


def positions(d: DataFrame) -> DataFrame:
    """Each case's place among its class by confidence, from 0 to 1, as means of right and wrong ones."""
    by = W.partitionBy("class")
    place = (F.row_number().over(by.orderBy("confidence", "doc_id")) - 0.5) / F.count("*").over(by)
    return d.withColumn("place", place).groupBy("class", "correct").agg(F.count("*").alias("n"), F.round(F.avg("place"), 6).alias("mean_place"))


def rotations(labels: DataFrame) -> DataFrame:
    """All cyclic rotations of the candidates, which are few: rotation, position, candidate."""
    n = W.partitionBy()
    c = labels.select("candidate").distinct()
    r = c.withColumn("i", F.row_number().over(W.orderBy("candidate")) - 1).withColumn("n", F.count("*").over(n))  # one row a label
    r = r.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("rotation"), "i", "n", "candidate")
    return r.select("rotation", F.pmod(F.col("i") - F.col("rotation"), F.col("n")).alias("position"), "candidate")
