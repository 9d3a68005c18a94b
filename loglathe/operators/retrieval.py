"""BM25 retrieval over documents, labels by containment, metrics of rankings.

Scores come first, from postings joined on terms; labels are joined to what was
scored afterwards, never the other way round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from ..storage import stored
from .containment import contained

K1, B = 1.5, 0.75
#: Tokens of which a term has more than one, if it is broadcast.
FREQUENT = 100_000
#: Lines by which a ranking is promoted or dropped, and queries at least.
PROMOTE, KILL, MARGIN, LEAST_QUERIES = {"r5": 0.80, "r1": 0.50}, 0.60, 0.10, 20


def postings(docs: DataFrame) -> DataFrame:
    """doc, term, tf, from columns doc and text."""
    return docs.select("doc", F.explode(X.retrieval_tokens(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.size(X.retrieval_tokens(F.col("text"))).cast("bigint").alias("dl"))


def statistics(docs: DataFrame) -> DataFrame:
    """Terms with their documents and idf, over the whole index."""
    n = lengths(docs).agg(F.count("*").alias("n"))
    df = postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, distinct: bool = False) -> DataFrame:
    """query, doc, score of all pairs that share a term; a query's repeated terms count again unless ``distinct``.

    Texts are tokenised once: postings of asked terms are stored, with a row
    for each document, from which the statistics come as well.  The queries'
    terms are stored first, so that Spark knows their size before it chooses
    how to join them.
    """
    terms = queries.select("query", F.explode(X.retrieval_tokens(F.col("text"))).alias("term"))
    terms = stored(terms.groupBy("query", "term").agg(F.lit(1).cast("bigint").alias("qn") if distinct else F.count("*").alias("qn")), "terms")
    tokens = docs.select("doc", X.retrieval_tokens(F.col("text")).alias("tokens"))
    each = tokens.select("doc", F.size("tokens").cast("bigint").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    known = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    asked = stored(each.join(known, "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    whole = asked.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = asked.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(whole)).select("query", "term", "qn", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))  # one row
    tf = F.col("tf").cast("double")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked.where("term <> ''").join(weighed, "term").groupBy("query", "doc").agg(F.round(F.sum(weight * F.col("qn")), 6).alias("score"))


def relevant(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query and doc of the documents that contain the query's text: one pass over each document for all queries."""
    texts = docs.select(F.lit(0).alias("session"), F.col("doc").alias("item"), "text")
    found = contained(texts, queries.select(F.lit(0).alias("session"), F.col("query").alias("fact"), F.col("text").alias("value")))
    kind = lambda df, c: df.schema[c].dataType
    return found.select(F.col("fact").cast(kind(queries, "query")).alias("query"), F.col("item").cast(kind(docs, "doc")).alias("doc"))


def ranked(scores: DataFrame) -> DataFrame:
    """Ranks by score, ties by document, and by newness."""
    by = lambda *o: W.partitionBy("query").orderBy(*o)
    return scores.withColumn("rank", F.row_number().over(by(F.desc("score"), "doc"))).withColumn("newest", F.row_number().over(by(F.desc("doc"))))


def labelled(r: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Relevant: the document contains the query's text."""
    pairs = relevant(docs, queries).withColumn("relevant", F.lit(True))
    return r.join(pairs, ["query", "doc"], "left").select("query", "doc", "score", "rank", "newest", F.coalesce("relevant", F.lit(False)).alias("relevant"))


def best_ranks(l: DataFrame) -> DataFrame:
    return l.groupBy("query").agg(F.count("*").alias("candidates"), F.count_if("relevant").alias("relevant"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"), F.min(F.when(F.col("relevant"), F.col("newest"))).alias("best_newest"))


def metrics(b: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@5, reciprocal rank and lower median of queries with a relevant document, for both orders."""
    rows = b.where("best is not null").select(F.explode(F.array(F.struct(F.lit("score").alias("ranking"), F.col("best").alias("r")), F.struct(F.lit("newest").alias("ranking"), F.col("best_newest").alias("r")))).alias("x")).select("x.*")
    at = lambda k: F.round(F.avg((F.col("r") <= k).cast("double")), 6).alias(f"hit_{k}")
    return rows.groupBy("ranking").agg(F.count("*").alias("queries"), at(1), at(3), at(5), F.round(F.avg(1.0 / F.col("r")), 6).alias("mrr"), F.expr("cast(percentile_disc(0.5) within group (order by r) as int)").alias("median_rank"))


def verdict(m: DataFrame) -> DataFrame:
    """kill, promote or neither, by recall and by its margin over the newest first."""
    p = m.groupBy().pivot("ranking", ["score", "newest"]).agg(F.first("hit_1").alias("r1"), F.first("hit_5").alias("r5"), F.first("queries").alias("n"))
    margin = F.round(F.col("score_r5") - F.col("newest_r5"), 6)
    v = F.when(F.col("score_n") < LEAST_QUERIES, "refused").when((F.col("score_r5") < KILL) | (margin < MARGIN), "kill").when((F.col("score_r5") >= PROMOTE["r5"]) & (F.col("score_r1") >= PROMOTE["r1"]), "promote").otherwise("neither")
    return p.select(F.col("score_n").alias("queries"), F.col("score_r1").alias("r1"), F.col("score_r5").alias("r5"), margin.alias("margin"), v.alias("verdict"))


def two_channels(docs: DataFrame, briefs: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of documents and of their briefs by distinct query terms, each as a share of the channel's best, and the larger."""
    best = W.partitionBy("query", "channel")
    one = lambda d, name: bm25(d, queries, distinct=True).withColumn("channel", F.lit(name))
    r = one(docs, "content").unionByName(one(briefs, "brief")).withColumn("unit", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("score"), F.max("score").over(best)))), 4))
    g = r.groupBy("query", "doc").agg(F.max(F.when(F.col("channel") == "content", F.col("unit"))).alias("content"), F.max(F.when(F.col("channel") == "brief", F.col("unit"))).alias("brief"))
    g = g.fillna(0.0, ["content", "brief"]).withColumn("score", F.greatest("content", "brief"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where("rank <= 5")


def salience(docs: DataFrame) -> DataFrame:
    """Each document's sentence of the highest mean ln(N / (1 + df)) of its terms.

    Texts are tokenised once: no token goes beyond a sentence.
    """
    sentences = docs.select("doc", F.posexplode(F.split("text", "[.!?]\\s+")).alias("n", "sentence"))
    sentences = stored(sentences.select("doc", "n", X.retrieval_tokens(F.col("sentence")).alias("tokens")), "sentences")
    tf = sentences.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = stored(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "terms")
    n = docs.agg(F.count("*").alias("total"))
    size = df.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    # terms with more than one token in FREQUENT are FREQUENT at most: broadcast, so that their tokens stay where they are
    hot = F.col("cf") * FREQUENT > size
    tokens = sentences.select("doc", "n", F.explode("tokens").alias("term"))
    known = tokens.join(F.broadcast(df.where(hot).select("term", "df")), "term", "left")
    rest = known.where("df is null").drop("df").join(df.where(~hot).select("term", "df"), "term")
    t = known.where("df is not null").select("doc", "n", "df").unionByName(rest.select("doc", "n", "df")).crossJoin(F.broadcast(n))  # one row
    s = t.groupBy("doc", "n").agg(F.round(F.avg(F.log(F.col("total") / (1.0 + F.col("df")))), 6).alias("score"), F.count("*").alias("terms"))
    first = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("score"), "n"))
    return s.withColumn("first", first).where("first = 1").select("doc", "n", "score", "terms")
