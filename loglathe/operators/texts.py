"""Extraction from texts, answers and verdicts, evidence previews, blind packets, seeded orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as X
from .ledgers import BY


def lines(t: DataFrame) -> DataFrame:
    """id, line (from 1), text of each line of texts (id, text)."""
    return t.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("id", (F.col("n") + 1).alias("n"), "line")


def definitions(t: DataFrame) -> DataFrame:
    """Definitions at the start of lines of up to 400 characters: the first pattern that matches counts."""
    l = lines(t).where(F.length("line") <= 400)
    found = [F.when(F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("identifier"))) for kind, p in X.DEFINITIONS]
    return l.withColumn("d", F.coalesce(*found)).where("d is not null").select("id", "n", "d.kind", "d.identifier")


def includes(t: DataFrame) -> DataFrame:
    l = lines(t).where(F.col("line").rlike(X.INCLUDE))
    return l.select("id", "n", F.regexp_extract("line", X.INCLUDE, 1).alias("target"))


def unique_identifiers(d: DataFrame) -> DataFrame:
    """Identifiers that are defined in exactly one text."""
    return d.groupBy("identifier").agg(F.countDistinct("id").alias("texts"), F.min("id").alias("id"), F.min("n").alias("n")).where("texts = 1").select("identifier", "id", "n")


def collisions(t: DataFrame, planted: DataFrame) -> DataFrame:
    """Planted words (column word) that texts already contain."""
    found = t.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({X.PLANTED})"), 1)).alias("word"))
    return found.join(planted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"), F.countDistinct("id").alias("texts"))


def file_facts(t: DataFrame) -> DataFrame:
    """Digest, lines (ends of line), characters and bytes of each text."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return t.select("id", F.sha2("text", 256).alias("sha"), breaks.cast("bigint").alias("lines"), F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"))


def manifest(t: DataFrame, parts: int = 256) -> DataFrame:
    """One digest of all texts, whatever their order: digests of parts by id, and the digest of those."""
    part = F.pmod(F.col("id"), F.lit(parts))
    inner = t.select(part.alias("part"), "id", F.sha2("text", 256).alias("sha")).groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sha"))), lambda x: F.concat_ws(":", x["id"], x["sha"])), ","), 256).alias("sha"), F.count("*").alias("n"))
    return inner.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"]), ","), 256).alias("sha"), F.sum("n").alias("texts"))


# ------------------------------------------------------------------ answers
def answers(e: DataFrame) -> DataFrame:
    """Each event's answer (none for errors) and the truth, the number that its kind had before in the session."""
    key = W.partitionBy("session", "kind").orderBy("ordinal")
    return e.select("session", "ordinal", "kind", F.lag("k").over(key).alias("truth"), F.when(F.col("kind") != "error", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint")).alias("answer"), F.lag("k", 2).over(key).alias("own"))


def verdict(answer: Column, truth: Column, near: int) -> Column:
    return F.when(answer.isNull(), "unanswered").when(truth.isNull(), "unknown").when(F.abs(answer - truth) <= near, "match").otherwise("mismatch")


def mechanical(a: DataFrame, near: int = 20) -> DataFrame:
    r = a.withColumn("verdict", verdict(F.col("answer"), F.col("truth"), near))
    return r.groupBy("kind", "verdict").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


def echoes(a: DataFrame, near: int = 20) -> DataFrame:
    """Whether an answer agrees with its own earlier one, by whether it agrees with the truth."""
    r = a.select(verdict(F.col("answer"), F.col("own"), near).alias("own"), verdict(F.col("answer"), F.col("truth"), near).alias("truth"))
    return r.groupBy("own", "truth").agg(F.count("*").alias("n"))


def integrity(a: DataFrame, near: int = 60) -> DataFrame:
    """How many of a session's first verdicts match without a break."""
    ok = (verdict(F.col("answer"), F.col("truth"), near).isin("match", "unknown")).cast("int")
    r = a.withColumn("ok", ok).withColumn("sofar", F.min("ok").over(BY()))
    return r.groupBy("session").agg(F.sum("sofar").alias("prefix"), F.count("*").alias("steps"), F.sum("ok").alias("matches"))


def recovery_windows(e: DataFrame, ask: str = "view", answer: str = "click", reset: str = "purchase") -> DataFrame:
    """Asks with the next answer, what lies between by kind, and the last reset before the ask."""
    after, before = BY().rowsBetween(1, W.unboundedFollowing), BY().rowsBetween(W.unboundedPreceding, -1)
    r = e.withColumn("answer", F.min(F.when(F.col("kind") == answer, F.col("ordinal"))).over(after)).withColumn("reset", F.max(F.when(F.col("kind") == reset, F.col("ordinal"))).over(before))
    counts = {k: F.count_if(F.col("kind") == k).over(BY()) for k in ("signup", "error")}
    for k, c in counts.items():
        r = r.withColumn(k, c)
    upto = r.select("session", F.col("ordinal").alias("answer"), F.col("signup").alias("signup_end"), F.col("error").alias("error_end"))
    r = r.where(F.col("kind") == ask).join(upto, ["session", "answer"], "left")
    return r.select("session", "ordinal", "answer", "reset", (F.col("signup_end") - F.col("signup")).alias("signups"), (F.col("error_end") - F.col("error")).alias("errors"))


def provenance(m: DataFrame, needle: str) -> DataFrame:
    """Rows that carry a whole word, who first wrote it, and how often it is echoed afterwards."""
    word = r"(?<![A-Za-z0-9_])" + needle + r"(?![A-Za-z0-9_])"
    r = m.withColumn("carries", F.lower("text").rlike(word))
    return r.where("carries").groupBy("session").agg(F.min("idx").alias("first"), F.min_by("role", "idx").alias("producer"), (F.count("*") - 1).alias("echoes"))


def normalized(m: DataFrame) -> DataFrame:
    """Each row's first line as an answer, and how many rows answer alike."""
    a = X.normalized_answer(F.element_at(F.split("text", "\n"), 1))
    return m.select(a.alias("answer"), "session").groupBy("answer").agg(F.count("*").alias("rows"), F.countDistinct("session").alias("sessions"))


# ----------------------------------------------------------------- evidence
def previews(t: DataFrame, budget: int) -> DataFrame:
    """Texts beyond the budget as a head and a line that refers to the artifact."""
    size = F.octet_length("text")
    head = X.utf8_head(F.col("text"), budget)
    r = t.where(size > budget).select("id", F.sha2("text", 256).alias("sha"), size.cast("bigint").alias("bytes"), head.alias("head"))
    line = F.concat(F.lit("[full text: sha256/"), F.left("sha", F.lit(2)), F.lit("/"), F.col("sha"), F.lit(", "), F.col("bytes").cast("string"), F.lit(" bytes]"))
    return r.select("id", F.octet_length("head").cast("bigint").alias("shown"), (F.col("bytes") - F.octet_length("head")).alias("omitted"), line.alias("reference"), F.sha2("head", 256).alias("head_sha"))


def artifacts(t: DataFrame) -> DataFrame:
    """Content-addressed rows: each digest once, with its place, size and owners."""
    r = t.select("id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes"))
    g = r.groupBy("sha").agg(F.first("bytes").alias("bytes"), F.min("id").alias("first_owner"), F.count("*").alias("owners"))
    return g.select(F.concat(F.lit("sha256/"), F.left("sha", F.lit(2)), F.lit("/"), F.col("sha")).alias("path"), "bytes", "first_owner", "owners")


def survival(t: DataFrame, cap: int) -> DataFrame:
    """How often each way to shorten a text keeps its longest word, by language."""
    words = F.transform(F.split(F.col("text"), "[^A-Za-z]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    r = t.select("lang", "text", F.array_max(words)["w"].alias("fact"))
    paragraphs = F.split("text", "\n")
    ways = {"head": F.left("text", F.lit(cap)), "tail": F.right("text", F.lit(cap)), "first line": F.element_at(paragraphs, 1), "first and last line": F.concat_ws("\n", F.element_at(paragraphs, 1), F.element_at(paragraphs, -1))}
    r = r.select("lang", "fact", F.explode(F.array(*(F.struct(F.lit(k).alias("way"), v.alias("brief")) for k, v in ways.items()))).alias("x")).select("lang", "fact", "x.*")
    return r.groupBy("lang", "way").agg(F.count("*").alias("texts"), F.count_if(F.col("brief").contains(F.col("fact"))).alias("carried"), F.round(F.avg(F.length("brief").cast("double")), 3).alias("mean_chars"))


# ------------------------------------------------------------ blind packets
def submission_ids(t: DataFrame, salt: str) -> DataFrame:
    return t.select("id", F.concat(F.lit("sub-"), F.left(F.sha2(F.concat(F.lit(salt + ":"), F.col("id").cast("string")), 256), F.lit(16))).alias("submission"))


def blind_packet(t: DataFrame, salt: str) -> DataFrame:
    """Texts under pseudonyms, in the pseudonyms' order, without what tells their source."""
    s = t.join(submission_ids(t, salt), "id")
    return s.select("submission", F.sha2("text", 256).alias("sha"), F.length("text").cast("bigint").alias("chars"))


def leaks(packet: DataFrame, forbidden: list[str]) -> DataFrame:
    """Columns of a packet that may not be in it."""
    spark = packet.sparkSession
    return spark.createDataFrame([(c,) for c in packet.columns if c in forbidden], "column string")


def seeded_sequence(seed: str, count: int) -> list[int]:
    """32-bit numbers from a chain of digests: eight from each, big-endian, each digest of the one before."""
    out: list[int] = []
    digest = hashlib.sha256(seed.encode()).digest()
    while len(out) < count:
        out += [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 32, 4)]
        digest = hashlib.sha256(digest).digest()
    return out[:count]


def seeded_shuffle(items: list, seed: str) -> list:
    """Fisher-Yates from the end, drawing from the sequence of the seed."""
    out = list(items)
    for n, draw in zip(range(len(out) - 1, 0, -1), seeded_sequence(seed, max(len(out) - 1, 0))):
        j = draw % (n + 1)
        out[n], out[j] = out[j], out[n]
    return out


def shuffled_sessions(m: DataFrame, seed: str) -> DataFrame:
    """Each session's rows in the order that its own seed gives."""
    r = m.groupBy("session").agg(F.sort_array(F.collect_list("idx")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(s, p, i) for s, rows in zip(*(c.to_pylist() for c in batch.columns)) for p, i in enumerate(seeded_shuffle(rows, f"{seed}:{s}"))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["session", "position", "idx"])

    return r.mapInArrow(run, "session long, position long, idx long")
