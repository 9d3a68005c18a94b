"""Analytics over ledgers: usage, cost, cache, repeats, waits, and joins of events in time.

Everything is declarative: windows over a session's order, conditional sums,
equi-joins; ``before`` and ``after`` are as-of joins as one window over a
union, so that neither side is ever crossed with the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Dollars for a million tokens (input, cache read, output), up to LONG prompt tokens and above.
LONG = 272_000
PRICES = {False: (5.0, 0.5, 30.0), True: (10.0, 1.0, 45.0)}
MUTATION_FLOOR, MUTATION_SHARE = 1024, 0.02

def BY():  # noqa: N802
    """A session's rows in order."""
    return W.partitionBy("session").orderBy("ordinal")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0, to 6 places."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, by: str = "session", forward: bool = False, strict: bool = True) -> DataFrame:
    """Each row of ``left`` with the nearest ``value`` of ``right`` before it (or after it) in ``at``.

    Columns of ``left`` and ``found``; rows at the same place count unless ``strict``.
    """
    mine, other = F.lit(0), F.lit(1)
    # at the same place, what counts comes nearer than the asking row
    rank = mine if strict != forward else other
    a = left.withColumn("_side", F.lit(0)).withColumn("_tie", rank).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (by, at) else F.col(f.name) for f in left.schema.fields]
    b = right.select(*empty, F.lit(1).alias("_side"), (1 - rank).alias("_tie"), F.col(value).alias("_value"))
    order = W.partitionBy(by).orderBy(F.col(at).desc() if forward else F.col(at), F.col("_tie").desc() if forward else F.col("_tie"))
    found = F.last("_value", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return a.unionByName(b).withColumn("found", found).where("_side = 0").drop("_side", "_tie", "_value")


# --------------------------------------------------------------------- usage
def usage_totals(p: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("input", "cache_read", "cache_write", "output")]
    return p.groupBy("session").agg(F.count("*").alias("requests"), *sums, F.sum(F.col("prompt") + F.col("output")).alias("total"))


def usage_rows(p: DataFrame) -> DataFrame:
    """Each request with the prompt before it, and whether the cache lost more than it may by chance."""
    prev = F.lag("prompt").over(BY())
    slack = F.greatest(F.lit(float(MUTATION_FLOOR)), F.col("prev_prompt") * MUTATION_SHARE)
    return p.withColumn("prev_prompt", prev).withColumn("mutated", F.coalesce(F.col("cache_read") < F.col("prev_prompt") - slack, F.lit(False)))


def usage_series(p: DataFrame) -> DataFrame:
    r = usage_rows(p)
    one = F.try_divide(F.col("cache_read").cast("double"), F.col("prompt").cast("double"))
    return r.groupBy("session").agg(
        F.count("*").alias("requests"),
        F.count_if("mutated").alias("mutations"),
        F.max("prompt").alias("max_prompt"),
        share(F.sum("cache_read"), F.sum("prompt")).alias("pooled_share"),
        F.round(F.avg(one), 6).alias("mean_share"),
    )


def usage_mutation_rollup(p: DataFrame) -> DataFrame:
    lost = F.when(F.col("mutated"), F.col("prev_prompt") - F.col("cache_read")).otherwise(0)
    r = usage_rows(p).groupBy("session").agg(F.count_if("mutated").alias("mutations"), F.sum(lost).alias("lost_tokens"), F.min(F.when(F.col("mutated"), F.col("ordinal"))).alias("first_mutation"))
    return r.groupBy("mutations").agg(F.count("*").alias("sessions"), F.sum("lost_tokens").alias("lost_tokens"), F.min("first_mutation").alias("earliest"))


def pooled_vs_mean(p: DataFrame) -> DataFrame:
    one = F.try_divide(F.col("cache_read").cast("double"), F.col("prompt").cast("double"))
    return p.groupBy("kind").agg(share(F.sum("cache_read"), F.sum("prompt")).alias("pooled_share"), F.round(F.avg(one), 6).alias("mean_share"), F.count("*").alias("requests"))


def billed_cost(p: DataFrame, long: int = LONG) -> DataFrame:
    above = F.col("prompt") > long
    # tenths of a millionth dollar are whole numbers, so that sums are exact in any order
    price = lambda i: F.when(above, int(10 * PRICES[True][i])).otherwise(int(10 * PRICES[False][i])).cast("bigint")
    cost = (F.col("input") + F.col("cache_write")) * price(0) + F.col("cache_read") * price(1) + F.col("output") * price(2)
    return p.groupBy("session").agg((F.sum(cost).cast("double") / 1e7).alias("usd"), F.count_if(above).alias("long_calls"), F.count_if(F.col("stop_reason") == "error").alias("unbilled"), F.max("prompt").alias("max_prompt"))


def out_of_band(p: DataFrame) -> DataFrame:
    source = F.when(F.col("kind") == "purchase", "compaction").when(F.col("kind") == "signup", "generator").otherwise("conversation")
    r = p.withColumn("source", source).rollup("source").agg(F.count("*").alias("calls"), F.sum("input").alias("fresh"), F.sum("output").alias("output"))
    return r.withColumn("source", F.coalesce("source", F.lit("total")))


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, ["session", "ordinal"], "left_anti")


def witness_reconcile(p: DataFrame) -> DataFrame:
    r = p.groupBy("session").agg(F.count("*").alias("requests"), F.count_if(F.col("stop_reason") != "error").alias("responses"), F.count_if(F.col("stop_reason") == "error").alias("markers"))
    gap = F.col("requests") - F.col("responses")
    return r.withColumn("consistent", (gap >= 0) & (gap <= F.col("markers")))


# ------------------------------------------------------------------- repeats
def reread_tax(t: DataFrame, by: str = "tool") -> DataFrame:
    first = F.row_number().over(W.partitionBy("session", "sha").orderBy("ordinal")) == 1
    r = t.withColumn("again", ~first)
    sums = [F.count("*").alias("results"), F.count_if(~F.col("again")).alias("distinct"), F.count_if("again").alias("repeats"), F.sum(F.when(F.col("again"), F.col("nbytes")).otherwise(0)).alias("repeat_bytes"), F.sum(F.when(F.col("again"), F.col("tokens")).otherwise(0)).alias("repeat_tokens")]
    return r.groupBy(by).agg(*sums, share(F.sum(F.when(F.col("again"), F.col("nbytes")).otherwise(0)), F.sum("nbytes")).alias("repeat_byte_share"))


def top_repeats(t: DataFrame, limit: int = 10) -> DataFrame:
    r = t.groupBy("session", "sha").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), (F.sum("tokens") - F.min_by("tokens", "ordinal")).alias("repeat_tokens"))
    return r.where("n > 1").orderBy(F.desc("repeat_tokens"), "session", "sha").limit(limit)


# --------------------------------------------------------------------- waits
def think_time(p: DataFrame) -> DataFrame:
    gap = F.lead("requested").over(BY()) - F.col("released")
    q = lambda x: F.expr(f"cast(percentile_disc({x}) within group (order by gap) as bigint)")
    return p.withColumn("gap", gap).where("gap is not null").groupBy("session").agg(F.count("*").alias("gaps"), F.max("gap").alias("max_gap"), q(0.95).alias("p95"), q(0.5).alias("median"))


def pace_audit(p: DataFrame, bound: int = 3_600_000) -> DataFrame:
    gap = F.col("released") - F.lag("released").over(BY())
    return p.withColumn("gap", gap).groupBy("session").agg(F.count_if(F.col("gap") > bound).alias("late"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") < 0).alias("backwards"))


def inflow(p: DataFrame, width: int = 8) -> DataFrame:
    """The largest of the last ``width`` positive steps of the prompt."""
    step = F.greatest(F.col("prompt") - F.lag("prompt").over(BY()), F.lit(0))
    top = F.max("step").over(BY().rowsBetween(1 - width, 0))
    return p.withColumn("step", step).select("session", "ordinal", "step", F.coalesce(top, F.lit(0)).alias("expected"))


# ----------------------------------------------------------- events in time
def weather(p: DataFrame) -> DataFrame:
    """Runs of errors with the good response before and after; a run between equal payloads is a cold restart."""
    bad = F.col("stop_reason") == "error"
    good = F.when(~bad, F.struct("ordinal", "props"))
    r = p.withColumn("run", F.sum((~bad).cast("int")).over(BY())).withColumn("before", F.last(good, True).over(BY().rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("after", F.first(good, True).over(BY().rowsBetween(1, W.unboundedFollowing))).where(bad)
    runs = r.groupBy("session", "run").agg(F.min("ordinal").alias("first"), F.count("*").cast("bigint").alias("errors"), F.min_by("before", "ordinal").alias("b"), F.max_by("after", "ordinal").alias("a"))
    return runs.select("session", "first", "errors", F.col("b.ordinal").alias("good_before"), F.col("a.ordinal").alias("good_after"), F.coalesce(F.col("b.props") == F.col("a.props"), F.lit(False)).alias("cold_restart"))


def stop_gaps(e: DataFrame, stop: str = "purchase", request: str = "view") -> DataFrame:
    """Each stop with the wait until the next request, and the session's median wait."""
    stops = e.where(F.col("kind") == stop).select("session", "ordinal", "wall_ms")
    later = e.where(F.col("kind") == request).select("session", "ordinal", "wall_ms")
    r = as_of(stops, later, "ordinal", "wall_ms", forward=True)
    gap = F.col("found") - F.col("wall_ms")
    return r.groupBy("session").agg(F.count("*").alias("stops"), F.count("found").alias("resumed"), F.max(gap).alias("max_gap"), F.round(F.expr("percentile(found - wall_ms, 0.5)"), 0).cast("bigint").alias("median_gap"))


def cohorts(e: DataFrame, record: str = "signup", request: str = "click") -> DataFrame:
    """Each record with the request before it; none: before the first commit."""
    records = e.where(F.col("kind") == record).select("session", "ordinal", "k")
    requests = e.where(F.col("kind") == request).select("session", "ordinal")
    r = as_of(records, requests.withColumn("at", F.col("ordinal")), "ordinal", "at")
    return r.select("session", "ordinal", "k", F.col("found").alias("request"), F.when(F.col("found").isNull(), "pre-commit").otherwise("cohort").alias("cohort"))


def receipt_missing(e: DataFrame, commit: str = "purchase", receipt: str = "signup", projection: str = "view") -> DataFrame:
    """Commits that no receipt follows before the next projection."""
    after = BY().rowsBetween(1, W.unboundedFollowing)
    nxt = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ordinal"))).over(after)
    r = e.withColumn("receipt", nxt(receipt)).withColumn("projection", nxt(projection)).where(F.col("kind") == commit)
    return r.where(F.col("projection").isNotNull() & (F.col("receipt").isNull() | (F.col("receipt") > F.col("projection")))).select("session", "ordinal", "projection")


def rollback_recovery(e: DataFrame, rollback: str = "error", recovery: str = "signup") -> DataFrame:
    """Rollbacks with the first recovery of the same number after them."""
    key = W.partitionBy("session", "k").orderBy("ordinal").rowsBetween(1, W.unboundedFollowing)
    r = e.withColumn("recovery", F.min(F.when(F.col("kind") == recovery, F.col("ordinal"))).over(key)).where(F.col("kind") == rollback)
    return r.select("session", "ordinal", "k", "recovery", F.col("recovery").isNotNull().alias("recovered"))


def surfacing(e: DataFrame, offer: str = "click", outcome: str = "purchase") -> DataFrame:
    """Offers with the last outcome of the same fold before it is offered again."""
    key = W.partitionBy("session", "k").orderBy("ordinal")
    r = e.where(F.col("kind").isin(offer, outcome)).withColumn("again", F.min(F.when(F.col("kind") == offer, F.col("ordinal"))).over(key.rowsBetween(1, W.unboundedFollowing)))
    r = r.withColumn("island", F.count_if(F.col("kind") == offer).over(key))
    last = F.max(F.when(F.col("kind") == outcome, F.col("ordinal"))).over(W.partitionBy("session", "k", "island"))
    return r.withColumn("outcome", last).where(F.col("kind") == offer).select("session", "ordinal", "k", "again", "outcome")


def request_classes(p: DataFrame, prefix: str = "click") -> DataFrame:
    """Each prefix with its class, by what happened since the prefix before, and the first usage until the next."""
    before = F.count_if(F.col("kind") == prefix).over(BY().rowsBetween(W.unboundedPreceding, -1))
    r = p.withColumn("island", F.coalesce(before, F.lit(0)))
    some = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    cls = F.when(some("error"), "after-rollback").when(some("signup"), "after-expand").when(some("purchase"), "after-fold").otherwise("unknown")
    own = r.groupBy("session", "island").agg(cls.alias("class"), F.max(F.when(F.col("kind") == prefix, F.struct("ordinal", "input", "cache_read", "cache_write", "prompt"))).alias("x"))
    return own.where("x is not null").select("session", "class", "x.*")


def request_class_cache(p: DataFrame) -> DataFrame:
    r = request_classes(p)
    return r.groupBy("class").agg(F.count("*").alias("requests"), F.count_if(F.col("cache_read") > 0).alias("hits"), F.count_if(F.col("cache_write") > 0).alias("writes"), F.sum("input").alias("fresh"), F.sum("cache_read").alias("read"), share(F.sum("cache_read"), F.sum("prompt")).alias("pooled_share"))


def counterfactual(p: DataFrame) -> DataFrame:
    """What the cache could have served: nothing first, else what the divergence left of the prompt before."""
    r = request_classes(p)
    prev = F.lag("prompt").over(BY())
    kept = F.when(F.col("prev").isNull(), 0).when(F.col("class") == "unknown", F.col("prev")).otherwise(F.least("cache_read", "prev"))
    r = r.withColumn("prev", prev).withColumn("served", F.least(kept, F.col("prompt")))
    return r.groupBy("class").agg(F.count("*").alias("requests"), F.sum("served").alias("served"), share(F.sum("served"), F.sum("prompt")).alias("counterfactual_share"), share(F.sum("cache_read"), F.sum("prompt")).alias("observed_share"))


def action_usage(p: DataFrame) -> DataFrame:
    return p.groupBy("kind").agg(F.count("*").alias("attempts"), F.count_if(F.col("stop_reason") == "stop").alias("accepted"), F.count_if(F.col("stop_reason") == "error").alias("errors"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.countDistinct("session").alias("sessions"))


def curation_mass(t: DataFrame) -> DataFrame:
    agent = F.col("tool").isin("purchase", "signup")
    mass = lambda c: F.sum(F.when(c, F.col("nbytes")).otherwise(0))
    return t.groupBy("session").agg(mass(agent).alias("agent"), mass(~agent).alias("ladder"), share(mass(agent), F.sum("nbytes")).alias("agent_share"))


def steward_windows(e: DataFrame, edge: float = 50.0, commit: str = "purchase") -> DataFrame:
    """Crossings into the band (values from ``edge``), until the next commit, with the accepted attempts inside."""
    inside = F.col("value") >= edge
    r = e.withColumn("crossing", inside & ~F.coalesce(F.lag("value").over(BY()) >= edge, F.lit(False)))
    r = r.withColumn("commit", F.min(F.when(F.col("kind") == commit, F.col("ordinal"))).over(BY().rowsBetween(1, W.unboundedFollowing)))
    clicks = F.count_if(F.col("kind") == "click").over(BY())
    r = r.withColumn("clicks", clicks)
    at = F.min(F.when(F.col("kind") == commit, F.struct("ordinal", "clicks"))).over(BY().rowsBetween(1, W.unboundedFollowing))
    return r.withColumn("at", at).where("crossing").select("session", "ordinal", "commit", F.when(F.col("commit").isNotNull(), F.col("at.clicks") - F.col("clicks")).alias("attempts"))


def last_calls(e: DataFrame, exposure: str = "view", response: str = "click") -> DataFrame:
    """Exposures with the next response of the same number, and all events in between."""
    key = W.partitionBy("session", "k").orderBy("ordinal").rowsBetween(1, W.unboundedFollowing)
    r = e.withColumn("response", F.min(F.when(F.col("kind") == response, F.col("ordinal"))).over(key)).where(F.col("kind") == exposure)
    return r.select("session", "ordinal", "k", "response", (F.col("response") - F.col("ordinal") - 1).alias("between"))


def brief_provenance(e: DataFrame, record: str = "signup", upgrade: str = "purchase") -> DataFrame:
    """Records with whether their number is among the upgraded ones, which commits list."""
    listed = e.where(F.col("kind") == upgrade).groupBy("session").agg(F.concat_ws(",", F.collect_set(F.col("k").cast("string"))).alias("ids"))
    upgraded = listed.select("session", F.explode(F.split("ids", ",")).alias("id")).select("session", F.col("id").cast("bigint").alias("k")).distinct().withColumn("model", F.lit(True))
    r = e.where(F.col("kind") == record).join(upgraded, ["session", "k"], "left")
    return r.groupBy("session").agg(F.count("*").alias("records"), F.count("model").alias("upgraded"))


def bytes_by_field(e: DataFrame, limit: int = 8) -> DataFrame:
    """The fields with most bytes in all states."""
    fields = F.create_map(*[x for name in ("kind", "props") for x in (F.lit(name), F.octet_length(name).cast("bigint"))], F.lit("ordinal"), F.length(F.col("ordinal").cast("string")).cast("bigint"), F.lit("session"), F.length(F.col("session").cast("string")).cast("bigint"))
    r = e.select(F.explode(fields).alias("field", "n")).groupBy("field").agg(F.sum("n").alias("nbytes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return r.orderBy(F.desc("nbytes"), "field").limit(limit)


# -------------------------------------------------------------------- chains
def seal(e: DataFrame) -> DataFrame:
    """Chained records: each digest covers the record, each record holds the digest before."""
    body = F.concat_ws("|", "session", "ordinal", "kind", "props")
    r = e.withColumn("record_sha", F.sha2(body, 256))
    return r.withColumn("prior_sha", F.lag("record_sha").over(BY())).select("session", "ordinal", "kind", "props", "record_sha", "prior_sha")


def audit_chain(records: DataFrame) -> DataFrame:
    """A session's breaks: ordinals that are not dense from 1, wrong links, wrong digests."""
    body = F.concat_ws("|", "session", "ordinal", "kind", "props")
    r = records.withColumn("n", F.row_number().over(BY())).withColumn("link", F.lag("record_sha").over(BY())).withColumn("own", F.sha2(body, 256))
    return r.groupBy("session").agg(F.count("*").alias("records"), F.count_if(F.col("ordinal") != F.col("n")).alias("gaps"), F.count_if(~F.col("link").eqNullSafe(F.col("prior_sha"))).alias("wrong_links"), F.count_if(F.col("own") != F.col("record_sha")).alias("wrong_digests"), F.max_by("record_sha", "ordinal").alias("head"))
