"""Which facts occur in which texts: one pass over each text for all facts of its session.

Facts of a session build an automaton that finds all of them at once; texts
stream past it.  Sessions with many characters are dealt into pieces, and those
with many facts into shards, so that no task holds a large session; only pairs
that occur come out, never pairs to be tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Bytes of texts in a piece, and facts in a shard.
PIECE, SHARD = 16 << 20, 20_000


def _dealt(df: DataFrame, amount, most: int, name: str) -> DataFrame:
    """Sessions that need more than one part: session and how many."""
    g = df.groupBy("session").agg(F.sum(amount).alias("amount"))
    return g.where(F.col("amount") > most).select("session", F.ceil(F.col("amount") / most).cast("int").alias(name))


def contained(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """session, fact, item, each once: over columns session, item, text and session, fact, value.

    Identifiers come back as strings.  Null or empty values occur nowhere, null
    texts hold nothing; sessions that are null meet only each other.  Both tables
    are stored, as they are read several times.
    """
    t = stored(texts.where("text is not null").select("session", F.col("item").cast("string").alias("id"), "text"), "texts")
    f = stored(facts.where("value <> ''").select("session", F.col("fact").cast("string").alias("id"), F.col("value").alias("text")), "facts")
    # a session without facts is not read
    t = t.join(f.select("session").distinct().withColumnRenamed("session", "asked"), F.col("session").eqNullSafe(F.col("asked")), "left_semi")
    pieces, shards = _dealt(t, F.octet_length("text").cast("bigint"), PIECE, "pieces"), _dealt(f, F.lit(1), SHARD, "shards")
    parts = lambda df: df.join(pieces, "session", "left").join(shards, "session", "left").fillna(1, ["pieces", "shards"])
    own = lambda n: F.array(F.pmod(F.xxhash64("id", "text"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = lambda df, p, s: parts(df).withColumn("piece", F.explode(p)).withColumn("shard", F.explode(s))
    rows = spread(f, every("pieces"), own("shards")).withColumn("side", F.lit(0)).unionByName(spread(t, own("pieces"), every("shards")).withColumn("side", F.lit(1)))
    schema = rows.select("session", F.col("id").alias("fact"), F.col("id").alias("item")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, finder, values = None, None, {}
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("session", "piece", "shard", "side", "id", "text")]
            for session, piece, shard, side, ident, text in zip(*columns):
                if (session, piece, shard) != now:
                    now, finder, values = (session, piece, shard), None, {}
                if side == 0:
                    values.setdefault(text, []).append(ident)
                    continue
                if not values:
                    continue
                if finder is None:
                    finder = ahocorasick.Automaton()
                    for value, idents in values.items():
                        finder.add_word(value, idents)
                    finder.make_automaton()
                seen = {id(idents): idents for _, idents in finder.iter(text)}
                found += ((session, fact, ident) for idents in seen.values() for fact in idents)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (batch.schema.field("session").type, pa.string(), pa.string()))], ["session", "fact", "item"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "session", "piece", "shard").sortWithinPartitions("session", "piece", "shard", "side")
    return placed.mapInArrow(scan, schema).distinct()
